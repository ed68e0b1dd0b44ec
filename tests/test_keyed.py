"""Per-key computations against brute force, with one key holding most rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tsubo.operators import keyed, telemetry

START = datetime(2024, 1, 1)
SCHEMA = "key long, ts timestamp, id long, failed boolean, status_code int"


def log(n=600, seed=3):
    """Requests with ties; key 1 holds more than a third, in bursts."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        at = START + timedelta(seconds=r.choice([0, 30, 60, 3599, 3600]) + 1800 * r.randrange(60))
        failed = r.random() < 0.5
        out.append((1 if r.random() < 0.5 else r.randrange(2, 9), at, i, failed, r.choice([500, 404]) if failed else 200))
    return out


@pytest.fixture(scope="module")
def requests(spark):
    return spark.createDataFrame(log(), SCHEMA).repartition(5)


def histories():
    per_key = {}
    for row in sorted(log(), key=lambda x: (x[0], x[1], x[2])):
        per_key.setdefault(row[0], []).append(row)
    return per_key


@pytest.mark.parametrize("chunk", ["minute", "hour", "day", "year"])
def test_progress(requests, chunk):
    want = {}
    for history in histories().values():
        failures = streak = 0
        for n, (_, _, i, failed, code) in enumerate(history, 1):
            failures += failed
            streak = streak + 1 if failed else 0
            by_streak = failed and streak >= 2 and code in (500, 429, 403)
            by_rate = failed and n >= 20 and failures / n >= 0.4
            want[i] = (n, failures, streak, by_streak, by_rate)
    got = {
        r.id: (r.n, r.failures, r.streak, r.streak_block, r.rate_block)
        for r in telemetry.progress(requests, chunk).collect()
    }
    assert got == want


def hot_hour(n=6000):
    """A third of all rows in one hour of one key, half of those within two seconds."""
    r = random.Random(11)
    rows = [(1, START + timedelta(microseconds=r.choice([r.randrange(3_600_000_000), 10**9 + r.randrange(2_000_000)])), i) for i in range(n // 3)]
    rows += [(r.randrange(2, 40), START + timedelta(seconds=r.randrange(40 * 86400)), i) for i in range(n // 3, n)]
    return [(*row, r.random() < 0.5, 500) for row in rows]


def test_a_hot_hour_is_spread_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(keyed, "HOT_ROWS", 50)
    rows = spark.createDataFrame(hot_hour(), SCHEMA).repartition(4)
    cut = keyed.chunked(rows, ["key"], F.date_trunc("hour", "ts"), "ts")
    sizes = sorted(r["count"] for r in cut.groupBy("key", "_chunk").count().collect())
    assert sum(sizes) == 6000 and sizes[-1] <= 6000 // 16
    per_task = sorted(r["count"] for r in cut.repartition(4, "key", "_chunk").groupBy(F.spark_partition_id()).count().collect())
    assert per_task[-1] <= 2 * per_task[len(per_task) // 2]
    # chunks follow the order, so results are those of whole keys
    whole = {r["id"]: r["n"] for r in rows.selectExpr("id", "row_number() OVER (PARTITION BY key ORDER BY ts, id) AS n").collect()}
    assert {r["id"]: r["n"] for r in keyed.running(
        rows, ["key"], ["ts", "id"], F.date_trunc("hour", "ts"), {"n": F.lit(1)}, at="ts").collect()} == whole
    for function in (telemetry.progress, telemetry.recent_failure_rate, lambda f: telemetry.trailing_counts(f, {"hour": 3})):
        with monkeypatch.context() as none:
            none.setattr(keyed, "HOT_ROWS", 10**9)
            plain = sorted(map(repr, function(rows).collect()))
        assert sorted(map(repr, function(rows).collect())) == plain


def test_rows_of_one_time_stay_together(spark, monkeypatch):
    monkeypatch.setattr(keyed, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(1, START + timedelta(seconds=i // 90), i, True, 500) for i in range(95)] + [(1, START, 100, True, 500)], SCHEMA)
    cut = keyed.chunked(rows, ["key"], F.date_trunc("hour", "ts"), "ts").groupBy("_chunk").agg(F.collect_set("ts").alias("t"), F.count("*").alias("n"))
    assert sorted((len(r["t"]), r["n"]) for r in cut.collect()) == [(1, 5), (1, 91)]


@pytest.mark.parametrize("block", [20, 23, 100_000])
def test_recent_failure_rate(requests, block, monkeypatch):
    monkeypatch.setattr(telemetry, "ROWS_PER_BLOCK", block)
    want = {}
    for history in histories().values():
        for n in range(1, len(history) + 1):
            last = history[max(0, n - 20):n]
            want[last[-1][2]] = sum(x[3] for x in last) / len(last)
    got = {r.id: r.recent_rate for r in telemetry.recent_failure_rate(requests).collect()}
    assert got == pytest.approx(want)


def test_trailing_counts_leave_exactly_at_the_end(requests):
    want = {}
    for history in histories().values():
        for _, at, i, *_ in history:
            spans = [timedelta(minutes=1), timedelta(hours=1), timedelta(days=1)]
            want[i] = tuple(sum(at - s < x[1] <= at for x in history) for s in spans)
    rows = telemetry.trailing_counts(requests, {"minute": 2, "day": 30}).collect()
    assert {r.id: (r.last_minute, r.last_hour, r.last_day) for r in rows} == want
    assert all(r.remaining_minute == max(2 - r.last_minute, 0) for r in rows)
    assert all(r.remaining_day == max(30 - r.last_day, 0) for r in rows)


def test_block_state(requests):
    as_of = START + timedelta(hours=30)
    want = {}
    for key, history in histories().items():
        failures = successes = 0
        block = None
        for _, at, _, failed, code in history:
            if failed:
                failures += 1
                block = (at, code) if code in (500, 429, 403) else block
            else:
                successes, failures, block = successes + 1, 0, None
        until = block and block[0] + timedelta(hours=1)
        want[key] = (failures, successes, block is not None, until, block is None or as_of > until)
    got = {
        r.key: (r.failure_count, r.success_count, r.is_blocked, r.blocked_until, r.can_run)
        for r in telemetry.block_state(requests, as_of).collect()
    }
    assert got == want


def test_no_window_task_holds_a_whole_key(requests):
    """Windows over raw rows are split by chunk; only chunk totals go by key."""
    for frame in (telemetry.progress(requests), telemetry.trailing_counts(requests, {})):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        for line in plan.splitlines():
            if "Window [" in line and "_chunk" not in line.split("],")[-2]:
                assert "_before_" in line or "_n0" in line or "_f0" in line or "_s0" in line or "_we" in line


def test_latest_and_numbered(spark, rows):
    df = spark.createDataFrame([(1, 1, "a"), (1, 3, "c"), (1, 2, "b"), (2, 9, "z")], "k int, o int, v string")
    assert rows(keyed.latest(df, ["k"], ["o"])) == [(1, 3, "c"), (2, 9, "z")]
    got = rows(keyed.numbered(df, ["k"], ["o"], F.floor(F.col("o") / 2), "n"))
    assert got == [(1, 1, "a", 1), (1, 2, "b", 2), (1, 3, "c", 3), (2, 9, "z", 1)]


def test_numbered_deals_rows_out_once(spark, rows, monkeypatch):
    r = random.Random(5)
    data = [(r.choice([1, 1, 1, 2, 3, 4, None]), r.randrange(30), i) for i in range(900)]
    df = spark.createDataFrame(data, "k int, o int, v int").repartition(3)
    want, seen = [], {}
    for k, o, v in sorted((x for x in data if x[0] is not None)):
        seen[k] = seen.get(k, 0) + 1
        want.append((k, o, v, seen[k]))
    number = lambda: keyed.numbered(df, ["k"], ["o", "v"], F.floor(F.col("o") / 4), "n")
    whole = number()
    assert whole._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert rows(whole) == sorted(want, key=repr)
    monkeypatch.setattr(keyed, "HOT_ROWS", 200)
    chunked = number()
    assert "_before_n" in chunked._jdf.queryExecution().optimizedPlan().toString()
    assert rows(chunked) == sorted(want, key=repr) and chunked.dtypes == whole.dtypes


def test_hour_band_wraps(apply):
    band = {}
    for hour in range(24):
        band[hour] = 20 if hour >= 22 or hour < 6 else 5 if 9 <= hour < 18 else 10
    got = apply(
        lambda c: telemetry.hour_band(c.cast("timestamp"), (22, 30, 20), (9, 18, 5), 10),
        [f"2024-01-01 {h:02d}:30:00" for h in band],
    )
    assert got == list(band.values())
    assert apply(lambda c: telemetry.hour_band(c.cast("timestamp"), (0, 1, 99), (1, 2, 0), 7), ["2024-01-01 00:00:00"]) == [60]
