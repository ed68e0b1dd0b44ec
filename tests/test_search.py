"""Options, cursors, pages, facets and keyword search."""

import base64
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tsubo import vocab
from tsubo.operators import facets, filters, joins, paging, scan, stats, textsearch
from tsubo.plans import search as plan
from tsubo.sources import fixtures as fx


@pytest.fixture(scope="module")
def listings(spark, folder):
    return fx.listings(spark, folder, title=True, walk=True, place=True).cache()


@pytest.mark.parametrize(
    "bad",
    [
        {"min_rent": 2, "max_rent": 1}, {"min_area": 2.0, "max_area": 1.0}, {"min_floor": 2, "max_floor": 1},
        {"min_building_age": 2, "max_building_age": 1}, {"sort": "price"},
    ],
)
def test_bad_options(bad):
    with pytest.raises(ValueError):
        plan.SearchOptions(**bad).check()


def test_long_lists_are_taken(listings):
    options = plan.SearchOptions(floor_plans=["1K"] * 21, exclude_ids=[f"x{i}" for i in range(501)]).check()
    frame = listings.filter("floor_plan = '1K'").select("id")
    without = plan.search(listings, None, plan.SearchOptions(exclude_ids=frame)).total.first().total
    assert plan.search(listings, None, options).total.first().total + without == listings.filter("status = 'active'").count()


def test_limits():
    assert [paging.checked_limit(n) for n in (None, 0, -1, 7, 20000, 50000)] == [50, 50, 50, 7, 20000, 50000]


def test_cursor_round_trip_keeps_fractions():
    at = datetime(2024, 1, 2, 3, 4, 5, 678901, tzinfo=timezone.utc)
    assert paging.decode_cursor(paging.encode_cursor(at, "x")) == (at, "x")


@pytest.mark.parametrize(
    "text, reason",
    [
        ("%%%", "base64"), (base64.urlsafe_b64encode(b"nope").decode(), "JSON"),
        (base64.urlsafe_b64encode(b'{"t":"2024-01-01T00:00:00Z"}').decode(), "lacks"),
        (base64.urlsafe_b64encode(b'{"t":"yesterday","id":"x"}').decode(), "time"),
        (base64.urlsafe_b64encode(b'{"t":"2024-01-01T00:00:00","id":"x"}').decode(), "time"),
    ],
)
def test_bad_cursors(text, reason):
    with pytest.raises(ValueError, match=reason):
        paging.decode_cursor(text)


def test_cursor_pages_give_the_whole_order(listings):
    rows = scan.active_listings(listings).select("id", "fetched_at")
    whole = [r.id for r in paging.ordered(rows, "newest").collect()]
    seen, cursor = [], ""
    while True:
        page = paging.page(rows, "newest", 400, cursor=cursor).collect()
        seen += [r.id for r in page]
        cursor = plan.next_cursor(page, 400)
        if not cursor:
            break
    assert seen == whole


def test_offset_pages_give_the_whole_order(listings):
    rows = scan.active_listings(listings).select("id", "rent", "fetched_at")
    whole = [r.id for r in paging.ordered(rows, "rent_asc").collect()]
    seen = []
    for offset in range(0, len(whole), 400):
        seen += [r.id for r in paging.page(rows, "rent_asc", 400, offset).collect()]
    assert seen == whole


def test_nulls_come_last_both_ways(listings):
    for mode in ("rent_asc", "rent_desc"):
        rents = [r.rent for r in paging.ordered(listings, mode).select("rent").collect()]
        first_null = rents.index(None)
        assert all(r is None for r in rents[first_null:])


def test_histogram_sums_to_rents_in_range(listings):
    in_range = listings.filter((F.col("status") == "active") & F.col("rent").between(0, 9_999_999)).count()
    assert sum(r.n for r in stats.rent_histogram(listings).collect()) == in_range
    empty = stats.rent_histogram(listings.filter("false")).collect()
    assert len(empty) == 6 and all(r.n == 0 for r in empty)


def test_unknown_amenity_is_an_error():
    with pytest.raises(ValueError, match="indoor_washer"):
        filters.has_facilities(["indoor_washer"])


def test_one_listing_with_children(spark, folder):
    listings, stations = fx.listings(spark, folder), fx.stations(spark, folder, ordered=True)
    images = fx.images(spark, folder)
    ident = listings.filter("order_key = 7").first().id
    one = scan.listing_with_children(listings, stations, images, ident)
    every = scan.with_children(listings, stations, images).filter(F.col("id") == ident)
    assert sorted(map(str, one.collect())) == sorted(map(str, every.collect()))
    assert {r.kind for r in one.collect()} == {"station", "image"}


def test_ids_of_children_are_made_distinct_before_they_are_dealt_out(spark, folder):
    listings, images = fx.listings(spark, folder), fx.images(spark, folder)
    plan = scan.with_children(listings, fx.stations(spark, folder, ordered=True), images)._jdf.queryExecution().optimizedPlan()
    alone = plan.toString().split("LeftAnti", 1)[1]
    assert "Aggregate [property_id" in alone and "Window" not in alone



def test_filters_reach_the_scan(spark, folder):
    rows = scan.active_listings(fx.listings(spark, folder)).select("id", "rent")
    plan_text = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_totalprice:double>" in plan_text
    assert "Join" not in plan_text and "Exchange" not in plan_text


def test_page_is_a_bounded_top_k(listings):
    text = paging.page(listings, "rent_desc", 50, 100)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in text


def test_deep_offset_sorts_on_all_tasks(listings):
    text = paging.page(listings, "rent_desc", 50, 5_000_000)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in text and "rangepartitioning" in text


def test_facet_rows(spark):
    df = spark.createDataFrame([("1K", "A"), ("1K", None), ("2K", "A")], "floor_plan string, station string")
    rows = facets.facets(df)
    assert sorted(map(tuple, rows.collect())) == [("floor_plan", "1K", 2), ("floor_plan", "2K", 1), ("station", "A", 2)]


def test_case_free_containment(spark):
    df = spark.createDataFrame([("Café",), ("tea",)], "station_name string")
    assert df.filter(joins.text_contains("station_name", "CAFE", True)).count() == 1
    assert df.filter(joins.text_contains("station_name", "CAFE")).count() == 0
    assert df.filter(joins.text_contains("station_name", "%")).count() == 0


def hits(spark, texts, query, **options):
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "id int, title string, station string")
    rows = textsearch.search_page(df, query, fields=["title", "station"], **options)
    return [(r.id, r.score, r.best_rank) for r in rows.collect()]


def test_keyword_search_ranks(spark):
    texts = [("Blue house", "Ueno"), ("ueno blue", "x"), ("red", "Blue"), ("bluebird", None)]
    assert hits(spark, texts, "blue UENO") == [(0, 2, 1), (1, 2, 1), (2, 1, 2)]
    assert hits(spark, texts, "ueno blue", prefix_last=True)[-1] == (2, 1, 2)
    assert (3, 1, 1) in hits(spark, texts, "ueno blue", prefix_last=True)
    assert len(hits(spark, texts, " ")) == 4


def test_near_words_are_those_by_edit_distance(spark, monkeypatch):
    rng = random.Random(2)
    tokens = ["house", "apartment", "stations", "été12", "abcdefghij"]

    def changed(word):
        for _ in range(rng.randrange(4)):
            i = rng.randrange(len(word) + 1)
            word = rng.choice([word[:i] + word[i + 1:], word[:i] + "x" + word[i:], word[:i] + "é" + word[i + 1:]])
        return word

    texts = sorted({changed(t) for t in tokens for _ in range(120)} | {"", "a"})
    words = textsearch.vocabulary(spark.createDataFrame([(t, None) for t in texts], "a string, b string"), ["a", "b"])

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {(t, w) for t in tokens for w in texts if w and 0 < distance(t, w) <= textsearch.allowed_edits(t)}
    found = [tuple(r) for r in textsearch.near_words(words, tokens).collect()]
    assert len(found) == len(set(found)) and set(found) == want
    # beyond the number of words that are listed, rows are measured; a kept vocabulary gives the same
    rows = spark.createDataFrame([(i, f"the {t}, now") for i, t in enumerate(texts)], "id int, a string")
    query = " ".join(tokens)
    listed = sorted(map(tuple, textsearch.scored(rows, query, ["a"], typos=True).collect()))
    assert listed == sorted(map(tuple, textsearch.scored(rows, query, ["a"], typos=True, words=words).collect()))
    monkeypatch.setattr(textsearch, "FEW_WORDS", 3)
    assert listed == sorted(map(tuple, textsearch.scored(rows, query, ["a"], typos=True).collect()))
    monkeypatch.setattr(textsearch, "LISTED_WORDS", 3)
    assert listed == sorted(map(tuple, textsearch.scored(rows, query, ["a"], typos=True).collect()))


def test_no_edit_distance_over_rows(spark):
    rows = spark.createDataFrame([(1, "a large hause")], "id int, a string")
    found = textsearch.scored(rows, "house", ["a"], typos=True)
    assert [r["id"] for r in found.collect()] == [1]
    assert "levenshtein" not in found._jdf.queryExecution().optimizedPlan().toString().lower()


def test_typos_by_length(spark):
    texts = [("house", ""), ("hause", ""), ("heuse2", ""), ("apartments", ""), ("apartmant", ""), ("blue", ""), ("blau", "")]
    found = {i for i, *_ in hits(spark, texts, "house", typos=True)}
    assert found == {0, 1}
    assert {i for i, *_ in hits(spark, texts, "apartment", typos=True)} == {3, 4}
    assert {i for i, *_ in hits(spark, texts, "blue", typos=True)} == {5}


def test_hits_keep_absent_numbers_null(spark):
    df = spark.createDataFrame([('{"id":"a","rent":5}',), ('{"id":"b","area":1.5}',)], "hit string")
    got = sorted((r.id, r.title, r.rent, r.area and float(r.area)) for r in textsearch.hit_rows(df).collect())
    assert got == [("a", "", 5, None), ("b", "", None, 1.5)]


def test_search_answer_parts_agree(listings):
    answer = textsearch.search_answer(
        listings, "building", ["floor_plan"], limit=5, condition=filters.yen_conditions(max_rent=200000), sort="rent_asc"
    )
    total = answer["total"].first().total
    assert total == answer["rows"].count() == sum(r.n for r in answer["facets"].collect())
    assert len(answer["hits"].collect()) == 5


def test_whole_search_page_and_total(listings, spark, folder):
    options = plan.SearchOptions(
        station="NATION_1", exclude_ids=["x"], facilities=["balcony"], max_walk=40, limit=10**6, sort="newest"
    )
    found = plan.search(listings, fx.stations(spark, folder), options)
    page = found.page.collect()
    assert len(page) == found.total.first().total
    assert all("balcony" in r.facilities and r.status == vocab.ACTIVE and r.walk_time <= 40 for r in page)
