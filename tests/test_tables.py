"""Merges, diffs, history, queue and retention on inline rows."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tsubo import schemas, vocab
from tsubo.functions import text
from tsubo.operators import diff, history, pages, paging, queue, retention, upsert
from tsubo.plans import ingest
from tsubo.sources import files
from tsubo.sources import fixtures as fx

T0, T1 = datetime(2024, 1, 1), datetime(2024, 1, 2)
COLUMNS = "id string, detail_url string, rent int, status string, removed_at timestamp, created_at timestamp"


@pytest.fixture
def current(spark):
    return spark.createDataFrame(
        [("a", "u1", 1, "active", None, T0), ("b", "u2", 2, "removed", T0, T0), ("c", "u3", 3, "active", None, T0)], COLUMNS
    )


@pytest.fixture
def incoming(spark):
    return upsert.prepared(
        spark.createDataFrame([("x", "u2", 20, "", None, T1), ("", "http://h/n/", 9, "", None, T1)], COLUMNS)
    )


def test_upsert_keeps_ids_and_maybe_status(current, incoming, rows):
    kept = {r.detail_url: r for r in upsert.upsert(current, incoming, ["detail_url"], ["created_at"], keep_status=True).collect()}
    assert (kept["u2"].id, kept["u2"].rent, kept["u2"].status, kept["u2"].removed_at) == ("b", 20, "removed", T0)
    revived = {r.detail_url: r for r in upsert.upsert(current, incoming, ["detail_url"], ["created_at"]).collect()}
    assert (revived["u2"].status, revived["u2"].removed_at, revived["u2"].created_at) == ("active", None, T0)
    assert len(revived["http://h/n/"].id) == 32 and revived["u1"].rent == 1


def test_upsert_is_idempotent(current, incoming, rows):
    once = upsert.upsert(current, incoming, ["detail_url"], ["created_at"])
    assert rows(upsert.upsert(once, incoming, ["detail_url"], ["created_at"])) == rows(once)


def test_upsert_takes_the_last_of_a_batch(current, spark):
    batch = spark.createDataFrame(
        [("x", "u1", 7, "active", None, T0), ("x", "u1", 8, "active", None, T1)], COLUMNS
    )
    merged = upsert.upsert(current, batch, ["detail_url"], order=["created_at"])
    assert merged.filter("detail_url = 'u1'").first().rent == 8


def test_children(spark, rows):
    old = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("c", "s3")], "property_id string, station_name string")
    new = spark.createDataFrame([("a", "n1")], old.schema)
    saved = spark.createDataFrame([("a",), ("b",)], "id string")
    assert rows(upsert.replace_children(old, new, saved)) == [("a", "n1"), ("b", "s2"), ("c", "s3")]
    assert rows(upsert.replace_children(old, new, saved, replace_empty=True)) == [("a", "n1"), ("c", "s3")]


def test_diff_partitions_the_ids(spark, folder):
    current, crawl = fx.listings(spark, folder), fx.crawl(spark, folder)
    kinds = diff.crawl_diff(current, crawl, ["fetched_at"], compared=["rent"])
    counts = {r.kind: r["count"] for r in kinds.groupBy("kind").count().collect()}
    active = current.filter("status = 'active'").select("id")
    union = active.union(crawl.select("id")).distinct().count()
    assert sum(counts.values()) == union == kinds.select("id").distinct().count()
    partial = diff.crawl_diff(current, crawl, ["fetched_at"], complete=False, compared=["rent"])
    assert partial.filter("kind = 'removed'").count() == 0
    assert partial.count() == union - counts["removed"]


def test_diff_compares_values_null_safe(spark, rows):
    columns = "id string, title string, rent int, image_url string, status string, seq int"
    a = spark.createDataFrame([("1", "t", None, "i", "active", 0), ("2", "t", 5, "i", "active", 0)], columns)
    b = spark.createDataFrame(
        [("1", "t", None, "i", "active", 0), ("2", "t", 6, "i", "active", 0), ("2", "t", 5, "i", "active", 1)], columns
    )
    assert rows(diff.crawl_diff(a, b, order=["seq"])) == [("1", "same"), ("2", "same")]


SNAPS = "property_id string, snapshot_at date, rent int, area decimal(10,2), status string"


def test_change_entries(spark):
    df = spark.createDataFrame(
        [("p", date(2024, 1, 1), None, None, "active"), ("p", date(2024, 1, 3), 5, None, "removed"),
         ("p", date(2024, 1, 4), 7, None, "removed")], SNAPS,
    )
    compared = history.compared_days(df)
    log = [tuple(r)[1:] for r in history.change_log(compared).orderBy("snapshot_at", "change_type").collect()]
    day = [date(2024, 1, n) for n in (1, 3, 4)]
    assert [(a, b, c, d, e and int(e)) for a, b, c, d, e in log] == [
        (day[0], "new_property", "", vocab.NEW_LISTING_NOTE, None),
        (day[1], "rent_changed", "nil", "5", None),
        (day[1], "status_changed", "active", "removed", None),
        (day[2], "rent_changed", "5", "7", 2),
    ]
    notes = {r.snapshot_at: (r.has_changed, r.change_note) for r in history.flagged(compared).collect()}
    assert notes[day[1]] == (True, "2 changes detected")


def test_snapshot_days_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    first = spark.createDataFrame([("p", date(2024, 1, 1), 1), ("p", date(2024, 1, 2), 2)], "property_id string, snapshot_at date, rent int")
    history.write_snapshots(first, path)
    history.write_snapshots(first.filter("rent = 2").withColumn("rent", F.lit(9)), path)
    assert sorted(r.rent for r in spark.read.parquet(path).collect()) == [1, 9]


def test_second_detection_of_a_day_gives_the_same_changes(spark, rows):
    listings = spark.createDataFrame([("p", 5, "active")], "id string, rent int, status string")
    before = spark.createDataFrame([("p", date(2024, 1, 1), 4, None, "active"), ("p", date(2024, 1, 2), 5, None, "active")], SNAPS)
    found = rows(history.change_log(history.detect_changes(listings, before, "2024-01-02 23:59:59")))
    assert [(r[1], r[2], r[3], r[4]) for r in found] == [(date(2024, 1, 2), "rent_changed", "4", "5")]
    # two kept days are as good as the whole history
    older = spark.createDataFrame([("p", date(2023, 1, n), n, None, "active") for n in range(1, 9)], SNAPS)
    kept = history.last_days(older.union(before))
    assert kept.count() == 2
    assert rows(history.change_log(history.detect_changes(listings, kept, "2024-01-02 23:59:59"))) == found


QUEUE = "id long, status string, attempts int, last_error string, next_retry_at timestamp, completed_at timestamp, updated_at timestamp"


def outcome_of(spark, attempts, outcomes):
    items = spark.createDataFrame([(1, "pending", attempts, "", None, None, T0), (2, "done", 0, "", None, T0, T0)], QUEUE)
    tried = spark.createDataFrame([(1, datetime(2024, 1, 1, 1, i), ok, e) for i, (ok, e) in enumerate(outcomes)],
                                  "id long, at timestamp, ok boolean, error string")
    got = {r.id: r for r in queue.apply_outcomes(items, tried).collect()}
    assert got[2].status == "done" and got[2].completed_at == T0
    return got[1]


def test_outcomes(spark):
    at = datetime(2024, 1, 1, 1, 0)
    done = outcome_of(spark, 0, [(True, None)])
    assert (done.status, done.attempts, done.completed_at, done.next_retry_at) == ("done", 1, at, None)
    lost = outcome_of(spark, 0, [(False, "status code 404")])
    assert (lost.status, lost.last_error) == ("permanent_fail", "404 Not Found (permanent): status code 404")
    blocked = outcome_of(spark, 4, [(False, "WAF block")])
    assert (blocked.status, blocked.next_retry_at) == ("failed", datetime(2024, 1, 1, 2, 0))
    for before, minutes in enumerate([5, 15, 60, 240]):
        retry = outcome_of(spark, before, [(False, "timeout")])
        assert (retry.next_retry_at - at).total_seconds() == minutes * 60 and retry.completed_at is None
    spent = outcome_of(spark, 4, [(False, "timeout")])
    assert (spent.status, spent.next_retry_at, spent.completed_at) == ("failed", None, at)
    assert spent.last_error == "Max retries exceeded (5): timeout"
    many = outcome_of(spark, 0, [(False, "timeout")] * 3 + [(True, None)] + [(False, "timeout")])
    assert (many.attempts, many.status, many.completed_at) == (5, "failed", datetime(2024, 1, 1, 1, 4))


def test_next_item_prefers_waiting_ones(spark):
    columns = "id long, status string, priority int, created_at timestamp, next_retry_at timestamp"
    items = [(1, "failed", 9, T0, T0), (2, "pending", 1, T1, None), (3, "pending", 1, T0, None), (4, "failed", 9, T0, None)]
    df = spark.createDataFrame(items, columns)
    assert [r.id for r in queue.next_items(df, T1, 9).collect()] == [3, 2, 1]


def test_retention(spark):
    rows = [("old", "t", "u", "removed", datetime(2023, 1, 1)), ("edge", "t", "u", "removed", datetime(2023, 10, 4)),
            ("odd", "t", "u", "removed", None), ("live", "t", "u", "active", None)]
    df = spark.createDataFrame(rows, "id string, title string, detail_url string, status string, removed_at timestamp")
    as_of = datetime(2024, 1, 2)
    run = retention.apply_retention(df, as_of)
    assert (run.target_count, {r.id for r in run.remaining.collect()}) == (1, {"edge", "odd", "live"})
    assert [(r.property_id, r.reason) for r in run.log.collect()] == [("old", "expired_90_days")]
    dry = retention.apply_retention(df, as_of, dry_run=True)
    assert dry.remaining.count() == 4 and dry.log.count() == 0 and [r.id for r in dry.listed.collect()] == ["old"]
    with pytest.raises(ValueError, match="would be deleted"):
        retention.apply_retention(df, as_of, cap=0)


def test_schemas(spark, folder, tmp_path):
    for name, schema in schemas.TABLES.items():
        assert schemas.empty(spark, name).schema == schema
    rows = fx.listings(spark, folder)
    assert schemas.violations(schemas.conform(rows, "properties"), "properties").count() == 0
    bad = schemas.conform(rows.limit(3).withColumn("status", F.lit("gone")), "properties")
    assert schemas.violations(bad, "properties").count() == 3
    path = str(tmp_path / "properties")
    files.write_version(rows, path, "properties")
    assert files.read_table(spark, path, "properties").count() == rows.count()
    with pytest.raises(Exception, match="already exists"):
        files.write_version(rows, path, "properties")


def test_export_counts(spark, folder, tmp_path):
    rows = fx.listings(spark, folder).select(F.when(F.col("order_key") != 3, F.col("id")).alias("id"), "rent")
    counts = files.export_index(rows, str(tmp_path / "index"), "json")
    assert counts == {"total": 1500, "indexed": 1499, "failed": 1}
    assert spark.read.json(str(tmp_path / "index")).count() == 1499


def test_url_list_and_answers(spark, tmp_path):
    path = tmp_path / "urls.txt"
    path.write_text("# head\n\n  https://a.example/1  \n　\n#x\nhttps://a.example/2\n", encoding="utf-8")
    assert [r.url for r in files.read_url_list(spark, str(path)).collect()] == ["https://a.example/1", "https://a.example/2"]
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    assert files.json_answer(df.orderBy("a"), "rows").first().json == '{"rows":[{"a":1},{"a":2,"b":"b"}],"count":2}'


def test_nothing_is_cut_in_silence(spark, apply):
    many = spark.range(30_000).withColumnRenamed("id", "a")
    assert json.loads(files.json_answer(many, "rows").first().json)["count"] == 30_000
    listings = many.select(F.col("a").cast("string").alias("id"), F.lit(T0).alias("fetched_at"))
    assert paging.page(listings, limit=30_000).count() == 30_000
    gone = many.select(F.col("a").cast("string").alias("id"), F.lit("").alias("title"), F.lit("").alias("detail_url"),
                       F.lit("removed").alias("status"), F.lit(datetime(2020, 1, 1)).alias("removed_at"))
    assert retention.apply_retention(gone, datetime(2024, 1, 2)).target_count == 30_000
    page = "".join(f'<img src="https://x/{i}.jpg">' for i in range(25))
    urls = apply(lambda c: F.size(pages.distinct_images(F.regexp_extract_all(c, F.lit("https://[^\"]+"), 0))), [page])
    assert urls == [25]
    address = "東京都" + "あ" * 80
    assert apply(text.address, [address]) == [address]


def test_store_twice_changes_nothing_more(spark, rows):
    html = ('<title>t</title>__SERVER_SIDE_CONTEXT__ {"Price":85000}<li class="DetailSummaryTable__access">'
            '<a class="_SummaryStation">新宿駅</a>/線 徒歩5分</li>"ExternalImageUrl":"https://i.example/1"')
    pages = spark.createDataFrame([(1, "https://a.example/rent/detail/" + "a" * 44, html)], "page_id int, url string, html string")
    empty = [schemas.empty(spark, t) for t in ("properties", "property_stations", "property_images", "property_snapshots")]
    got = ingest.split(ingest.page_rows(pages, "demo", T0))
    first = ingest.store(got, *empty, T0)
    again = ingest.store(got, first.listings, first.stations, first.images, schemas.conform(first.snapshots, "property_snapshots"), T1)
    for name in ("listings", "stations", "images"):
        assert rows(getattr(again, name)) == rows(getattr(first, name))
    assert first.changes.count() == 1 and again.changes.count() == 0
    # a page without children keeps the stored ones
    bare = ingest.split(ingest.page_rows(pages.withColumn("html", F.lit("<title>t</title>")), "demo", T1))
    kept = ingest.store(bare, first.listings, first.stations, first.images, empty[3], T1)
    assert kept.stations.count() == 1 and kept.images.count() == 1
    emptied = ingest.store(bare, first.listings, first.stations, first.images, empty[3], T1, replace_empty=True)
    assert emptied.stations.count() == 0 and emptied.images.count() == 0


def test_outcomes_against_one_by_one(spark):
    """Random outcome rows, most of them on one item, against a plain loop."""
    import random
    from datetime import timedelta

    r = random.Random(5)
    delays = [300, 900, 3600, 14400, 43200]
    start = {i: r.randrange(0, 4) for i in range(8)}
    tried = []
    for seq in range(160):
        item = 0 if r.random() < 0.5 else r.randrange(1, 8)
        error = r.choice(["", "timeout", "timeout", "WAF", "404"])
        tried.append((item, seq, T0 + timedelta(minutes=r.randrange(4000)), error == "", error))
    want = {}
    for i, attempts in start.items():
        state = ["pending", attempts, "", None, None]
        for _, _, at, ok, error in sorted((t for t in tried if t[0] == i), key=lambda t: (t[2], t[1])):
            attempts += 1
            if ok:
                state = ["done", attempts, "", None, at]
            elif error == "404":
                state = ["permanent_fail", attempts, "404 Not Found (permanent): 404", None, at]
            elif error == "WAF":
                state = ["failed", attempts, "WAF/circuit breaker: WAF", at + timedelta(hours=1), state[4]]
            elif attempts >= 5:
                state = ["failed", attempts, f"Max retries exceeded ({attempts}): timeout", None, at]
            else:
                state = ["failed", attempts, "timeout", at + timedelta(seconds=delays[attempts - 1]), state[4]]
        want[i] = tuple(state)
    for parts in (1, 3):
        # the same outcomes applied in one go or in several in time order
        ordered = sorted(tried, key=lambda t: (t[2], t[1]))
        items = spark.createDataFrame([(i, "pending", n, "", None, None, T0) for i, n in start.items()], QUEUE)
        step = -(-len(ordered) // parts)
        for at in range(0, len(ordered), step):
            part = spark.createDataFrame(ordered[at:at + step], "id long, seq long, at timestamp, ok boolean, error string")
            items = queue.apply_outcomes(items, part, ("at", "seq"))
        got = {
            x.id: (x.status, x.attempts, x.last_error, x.next_retry_at, x.completed_at) for x in items.collect()
        }
        assert got == want
