"""Streams give what the batch gives, however a table is cut into files."""

import random

import pandas as pd
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tsubo.operators import history, queue
from tsubo.plans.catalog import CATALOG
from tsubo.session import work_dir
from tsubo.streaming import jobs

STREAMS = sorted(name for name in CATALOG if name.startswith(("r1", "r2", "r3", "r4", "r5")))
TABLES = ("events", "lineitem", "orders", "customer", "nation", "supplier")


@pytest.fixture(scope="module")
def cut(folder, tmp_path_factory):
    """The tables as folders: by Spark's file names, and as 40 files of shuffled rows."""
    roots = {kind: tmp_path_factory.mktemp(kind) for kind in ("spark", "shuffled")}
    for name in TABLES:
        table = pq.read_table(f"{folder}/{name}.parquet")
        order = list(range(len(table)))
        random.Random(7).shuffle(order)
        for kind, rows, n in (("spark", table, 3), ("shuffled", table.take(order), 40 if name in ("events", "lineitem") else 1)):
            (roots[kind] / f"{name}.parquet").mkdir()
            step = -(-len(rows) // n)
            for i in range(n):
                pq.write_table(rows.slice(i * step, step), roots[kind] / f"{name}.parquet" / f"part-{i:05d}-c000.snappy.parquet")
    return {k: str(v) for k, v in roots.items()}


@pytest.mark.parametrize("name", STREAMS)
def test_registered_streams_do_not_depend_on_files(spark, folder, cut, rows, name):
    run = CATALOG[name].run
    whole = rows(run(spark, folder))
    assert whole
    assert rows(run(spark, cut["spark"])) == whole
    assert rows(run(spark, cut["shuffled"])) == whole


REQUEST = "key bigint, ts timestamp, id bigint, failed boolean, status_code int"


class Feed:
    """A folder that gets one file per micro-batch, and the job that reads it, stopped and started for each."""

    def __init__(self, spark, folder, schema, job, texts=()):
        self.spark, self.folder, self.schema, self.job, self.texts = spark, str(folder), schema, job, texts
        self.root = work_dir(spark, "feed")

    def frame(self, rows):
        kinds = ", ".join(f"{c.split()[0]} {'string' if c.split()[0] in self.texts else c.split()[1]}" for c in self.schema.split(", "))
        frame = self.spark.createDataFrame(rows, kinds)
        return frame.selectExpr(*[f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in self.schema.split(", ")])

    def take(self, *parts):
        """Each part is a file, and so a micro-batch."""
        for rows in parts:
            self.frame(rows).coalesce(1).write.mode("append").parquet(self.folder)
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.folder)
        jobs.finish(self.job(stream, self.root))

    def batches(self):
        """Rows written by each micro-batch."""
        rows = self.spark.read.parquet(f"{self.root}/rows").groupBy("batch").count().collect()
        return {r["batch"]: r["count"] for r in rows}


def requests(rng, n, keys=3):
    start = pd.Timestamp("2024-01-01")
    return [(rng.randrange(keys), str(start + pd.Timedelta(minutes=rng.randrange(6 * n))), i, rng.random() < 0.4, 500) for i in range(n)]


def counted(rows_of):
    """n, failures, streak and recent rate of each request, one by one."""
    state, found = {}, {}
    for key, _, ident, failed, _ in sorted(rows_of, key=lambda r: (r[0], r[1], r[2])):
        seen = state.setdefault(key, [])
        seen.append(failed)
        streak = next((i for i, f in enumerate(reversed(seen)) if not f), len(seen))
        found[ident] = (len(seen), sum(seen), streak, round(sum(seen[-20:]) / len(seen[-20:]), 9))
    return found


def shown(frame):
    return {r["id"]: (r["n"], r["failures"], r["streak"], round(r["recent_rate"], 9)) for r in frame.collect()}


def test_a_late_row_corrects_an_earlier_result(spark, tmp_path, rows):
    """Two files; the later file holds the earlier event."""
    feed = Feed(spark, tmp_path, REQUEST, jobs.write_progress, ("ts",))
    found = []
    for row in [(1, "2024-01-02 10:00:00", 2, True, 500), (1, "2024-01-01 10:00:00", 1, True, 500)]:
        feed.take([row])
        found.append(rows(jobs.read_progress(spark, feed.root).select("id", "n", "streak")))
    assert found == [[(2, 1, 1)], [(1, 1, 1), (2, 2, 2)]]


def test_progress_of_requests_in_any_order(spark, tmp_path):
    """After each batch the result is that of all requests so far; released, waiting and late ones occur."""
    feed = Feed(spark, tmp_path, REQUEST, jobs.write_progress, ("ts",))
    every = requests(random.Random(3), 120)
    order = sorted(every, key=lambda r: r[1])
    late = order[10:14]
    parts = [order[:10] + order[14:50], order[50:80], order[80:110] + late[:3], order[110:] + late[3:]]
    for i, part in enumerate(parts):
        feed.take(random.Random(i).sample(part, len(part)))
        assert shown(jobs.read_progress(spark, feed.root)) == counted(sum(parts[:i + 1], []))
    kinds = {r["part"] for r in spark.read.parquet(f"{feed.root}/rows").select("part").distinct().collect()}
    assert kinds == {"done", "waiting", "late"}


def test_a_batch_of_progress_costs_the_same_after_a_long_history(spark, tmp_path):
    feed = Feed(spark, tmp_path, REQUEST, jobs.write_progress, ("ts",))
    for i in range(5):
        start = pd.Timestamp("2024-01-01") + pd.Timedelta(days=i)
        feed.take([(k, str(start + pd.Timedelta(minutes=3 * m)), 1000 * i + 10 * m + k, m % 3 == 0, 500) for m in range(40) for k in range(2)])
    written = feed.batches()
    # a file is one batch with its rows and one without, which releases what the watermark has passed
    sizes = [written[b] + written.get(b + 1, 0) for b in range(0, 10, 2)]
    assert max(sizes[2:]) <= max(sizes[:2]) + 80
    assert len(shown(jobs.read_progress(spark, feed.root))) == 5 * 80


def test_window_counts_keep_late_rows_and_merge_batches(spark, tmp_path, rows):
    feed = Feed(spark, tmp_path, REQUEST, lambda s, root: jobs.write_counts(s, root, every=3), ("ts",))
    every = requests(random.Random(4), 70) + [(1, None, 999, True, 500), (2, "2020-01-01 00:00:59", 1000, True, 500)]
    random.Random(5).shuffle(every)
    feed.take(*[every[i:i + 9] for i in range(0, len(every), 9)])
    frame = feed.frame(every).filter("ts IS NOT NULL")
    for size, slide in (("1 minute", None), ("1 hour", None), ("1 day", None), ("1 hour", "30 minutes")):
        span = F.window("ts", size, slide) if slide else F.window("ts", size)
        batch = frame.groupBy("key", span.alias("w")).agg(F.count("*").alias("n"), F.count_if("failed").alias("failed"))
        assert rows(jobs.read_counts(spark, feed.root, size, slide)) == rows(batch.select("key", "w.start", "w.end", "n", "failed"))
    # batches 2 and 5 were merged; the last base is read, and the partial rows after it
    bases = spark.read.parquet(f"{feed.root}/base").inputFiles()
    assert any("upto=2/" in f for f in bases) and any("upto=5/" in f for f in bases)
    assert jobs._partials(spark, feed.root).groupBy("key", "minute").count().agg(F.max("count")).first()[0] <= 3


OUTCOME = "id bigint, at timestamp, seq bigint, ok boolean, error string"


def test_queue_of_shuffled_batches_is_that_of_one(spark, tmp_path, rows):
    rng = random.Random(6)
    errors = ["timeout", "404 gone", "WAF", "permanent_fail", None, "circuit breaker open"]
    every = [(rng.choice([1, 1, 1, *range(12)]), str(pd.Timestamp("2024-01-01") + pd.Timedelta(hours=rng.randrange(40))), i, rng.random() < 0.3, rng.choice(errors)) for i in range(160)]
    start = spark.createDataFrame(
        [(i, "pending", i % 5, "", None, None, None) for i in range(13)],
        "id bigint, status string, attempts int, last_error string, next_retry_at timestamp, completed_at timestamp, updated_at timestamp")
    feed = Feed(spark, tmp_path, OUTCOME, lambda s, root: jobs.write_outcomes(s, root, ("at", "seq"), every=6), ("at",))
    feed.take(*[every[i:i + 8] for i in range(0, 160, 8)])
    whole = rows(queue.apply_outcomes(start, feed.frame(every), ("at", "seq")))
    assert rows(jobs.read_queue(start, feed.root)) == whole
    # what is read are summaries: two open batches and a base with a row per item
    assert jobs._partials(spark, feed.root).groupBy("id").count().agg(F.max("count")).first()[0] <= 3


def one_by_one(items, outcomes):
    """Outcomes applied to items {id: attempts}, one after the other: status, attempts, error, completion."""
    state = {i: ["pending", n, "", None] for i, n in items.items()}
    for ident, at, _, ok, error in sorted(outcomes, key=lambda o: (o[1], o[2])):
        if ident not in state:
            continue
        row, error = state[ident], error or ""
        row[1] += 1
        if ok:
            row[0], row[2], row[3] = "done", "", at
        elif "404" in error or "permanent_fail" in error:
            row[0], row[2], row[3] = "permanent_fail", f"404 Not Found (permanent): {error}", at
        elif "WAF" in error or "circuit breaker open" in error:
            row[0], row[2] = "failed", f"WAF/circuit breaker: {error}"
        elif row[1] >= 5:
            row[0], row[2], row[3] = "failed", f"Max retries exceeded ({row[1]}): {error}", at
        else:
            row[0], row[2] = "failed", error
    return {i: tuple(r) for i, r in state.items()}


def test_summaries_give_what_one_by_one_processing_gives(spark):
    rng = random.Random(9)
    errors = ["timeout", "404 gone", "WAF", None, "refused"]
    items = {i: i % 6 for i in range(40)}
    every = [(rng.randrange(42), f"2024-01-{1 + rng.randrange(28):02d} 00:00:00", i, rng.random() < 0.15, rng.choice(errors)) for i in range(300)]
    start = spark.createDataFrame(
        [(i, "pending", n, "", None, None, None) for i, n in items.items()],
        "id bigint, status string, attempts int, last_error string, next_retry_at timestamp, completed_at timestamp, updated_at timestamp")
    outcomes = spark.createDataFrame(every, "id bigint, at string, seq bigint, ok boolean, error string").withColumn("at", F.col("at").cast("timestamp"))
    found = queue.apply_outcomes(start, outcomes, ("at", "seq")).select("id", "status", "attempts", "last_error", F.col("completed_at").cast("string")).collect()
    assert {r[0]: tuple(r)[1:] for r in found} == one_by_one(items, every)


SNAPSHOT = "property_id string, snapshot_at date, rent bigint, status string, line bigint"


def test_a_late_day_replaces_two_change_rows(spark, tmp_path, rows):
    feed = Feed(spark, tmp_path, SNAPSHOT, lambda s, root: jobs.write_snapshots(s, root, ["line"]), ("snapshot_at",))
    days = [f"20{y}-{m:02d}-01" for y in (23, 24) for m in range(1, 13)]
    feed.take([(p, d, 100 + i % 5, "active", 1) for p in "ab" for i, d in enumerate(days) if d != "2023-12-01"])
    feed.take([("a", "2023-12-01", 777, "active", 1)])  # the day after it is in another year
    feed.take([("b", "2024-06-01", 1, "active", 0), ("b", "2024-12-01", 103, "active", 5)])  # an older row, and an equal newer one
    feed.take([("a", "2022-05-05", None, None, 1), ("c", "2024-01-01", 5, "removed", 1), ("c", "2024-01-01", 6, "removed", None)])
    assert {b: n for b, n in feed.batches().items() if b > 0} == {1: 2, 3: 3}
    every = spark.read.schema(SNAPSHOT).parquet(str(tmp_path))
    daily = history.one_per_day(every, ["line"]).drop("line")
    assert rows(jobs.read_changes(spark, feed.root)) == rows(history.change_log(history.compared_days(daily)))


def test_repeats_are_dropped_however_late_they_come(spark, tmp_path, rows):
    feed = Feed(spark, tmp_path, REQUEST, lambda s, root: jobs.write_distinct(s, root, ["id"]), ("ts",))
    every = requests(random.Random(8), 200)
    feed.take(every[:90] + every[:30])
    feed.take(every[60:150])
    feed.take([])
    feed.take(every[::-1] + [(1, None, 5000, True, 500)] * 2)
    feed.take([(1, None, 5000, True, 500)])
    found = jobs.read_rows(spark, feed.root)
    assert found.columns == ["key", "ts", "id", "failed", "status_code"]
    assert [r["id"] for r in found.orderBy("id").collect()] == [*range(200), 5000]


@pytest.mark.parametrize("write, read", [
    (jobs.write_progress, jobs.read_progress), (jobs.write_counts, lambda s, r: jobs.read_counts(s, r, "1 hour")),
    (lambda s, r: jobs.write_distinct(s, r, ["id"]), jobs.read_rows)])
def test_an_empty_stream_can_be_read(spark, tmp_path, write, read):
    stream = spark.readStream.schema(REQUEST).parquet(str(tmp_path))
    root = work_dir(spark, "empty")
    jobs.finish(write(stream, root))
    assert read(spark, root).collect() == []


def test_work_dir_needs_a_shared_folder(spark):
    class Cluster:
        class sparkContext:
            master = "spark://host:7077"

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_dir(Cluster, "x")
