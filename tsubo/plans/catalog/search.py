"""Scans, filters, existence tests, order, pages and text search."""

from __future__ import annotations

import hashlib
from datetime import datetime, timezone

from pyspark.sql import functions as F

from tsubo import schemas, vocab
from tsubo.operators import diff, facets, filters, joins, paging, scan, textsearch
from tsubo.plans import search as plan
from tsubo.plans.catalog.base import entry, stamp, stamp_sql, text_list
from tsubo.sources import files
from tsubo.sources import fixtures as fx


def ident(key: object) -> str:
    return hashlib.md5(f"demo:{key}".encode()).hexdigest()


# -------------------------------------------------------------------- scans
@entry("s1_scan_all", f"SELECT id, status, {stamp_sql('created_at')} AS created FROM listings")
def _(spark, d):
    return scan.all_listings(fx.listings(spark, d)).select("id", "status", stamp("created_at").alias("created"))


@entry("s2_scan_active", "SELECT id, rent, floor_plan FROM listings WHERE status = 'active'")
def _(spark, d):
    return scan.active_listings(fx.listings(spark, d)).select("id", "rent", "floor_plan")


@entry("s3_lookup_by_id", f"SELECT id, rent, status, detail_url FROM listings WHERE id = '{ident(7)}'")
def _(spark, d):
    return scan.by_id(fx.listings(spark, d), ident(7)).select("id", "rent", "status", "detail_url")


@entry(
    "s4_children_of_listing",
    f"""SELECT sort_order, station_name, line_name, walk_minutes FROM stations
        WHERE property_id = '{ident(7)}'""",
)
def _(spark, d):
    rows = scan.children_of(fx.stations(spark, d, ordered=True), ident(7))
    return rows.select(F.col("sort_order").cast("bigint").alias("sort_order"), "station_name", "line_name", "walk_minutes")


@entry(
    "s5_listings_with_children",
    """SELECT l.id, c.kind, CAST(c.sort_order AS BIGINT) AS sort_order, c.value, c.walk_minutes
       FROM listings l LEFT JOIN (
           SELECT property_id, 'station' AS kind, sort_order, station_name AS value, walk_minutes FROM stations
           UNION ALL SELECT property_id, 'image', sort_order, image_url, NULL FROM images) c
       ON l.id = c.property_id""",
)
def _(spark, d):
    rows = scan.with_children(
        fx.listings(spark, d), fx.stations(spark, d, ordered=True), fx.images(spark, d)
    )
    return rows.select("id", "kind", F.col("sort_order").cast("bigint").alias("sort_order"), "value", "walk_minutes")


@entry("s6_url_list", "SELECT url FROM pages WHERE page_id % 3 <> 1")
def _(spark, d):
    k = F.col("page_id")
    line = F.when(k % 3 == 1, F.concat(F.lit(" # "), "url")).otherwise(F.concat(F.lit("  "), "url", F.lit("\t")))
    lines = fx.pages(spark, d).select(F.explode(F.array(line, F.lit("   "))).alias("value"))
    return files.url_lines(lines)


@entry(
    "s7_index_documents",
    f"""SELECT id, detail_url, title, image_url, station, address, floor_plan, status, rent,
               CAST(area AS DOUBLE) AS area, walk_time, building_age, floor, {stamp_sql('created_at')} AS created_at
        FROM listings""",
)
def _(spark, d):
    docs = files.index_documents(fx.listings(spark, d, title=True, walk=True, place=True))
    return docs.withColumns({"area": F.col("area").cast("double"), "created_at": stamp("created_at")})


@entry(
    "s8_conformed_rows",
    """SELECT status, count(*) AS n, count(rent) AS with_rent, CAST(0 AS BIGINT) AS with_notes,
              CAST(0 AS BIGINT) AS violations
       FROM listings GROUP BY status""",
)
def _(spark, d):
    rows = schemas.conform(fx.listings(spark, d), "properties")
    bad = schemas.violations(rows, "properties").groupBy("status").agg(F.count("*").alias("bad"))
    counts = rows.groupBy("status").agg(
        F.count("*").alias("n"), F.count("rent").alias("with_rent"), F.count("notes").alias("with_notes")
    )
    return counts.join(bad, "status", "left").select(
        "status", "n", "with_rent", "with_notes", F.coalesce("bad", F.lit(0)).alias("violations")
    )


@entry(
    "s9_json_rows",
    """SELECT '{"id":"' || id || '"' || coalesce(',"rent":' || rent, '') || ',"status":"' || status || '"}' AS json
       FROM listings""",
)
def _(spark, d):
    return files.json_rows(fx.listings(spark, d), "id", "rent", "status")


@entry(
    "s10_unpaged_list",
    """SELECT l.id, l.status, l.rent FROM listings l
       WHERE walk_time <= 10
         AND EXISTS (SELECT 1 FROM stations s WHERE s.property_id = l.id AND s.station_name LIKE '%NATION_2%')
         AND EXISTS (SELECT 1 FROM stations s WHERE s.property_id = l.id AND s.line_name LIKE '%7%')""",
)
def _(spark, d):
    options = plan.SearchOptions(station="NATION_2", line="7", max_walk=10, sort="rent_asc")
    return plan.unpaged(fx.listings(spark, d, walk=True), fx.stations(spark, d), options).select("id", "status", "rent")


# ------------------------------------------------------------------ filters
def _filtered(spark, d, *conditions, **parts):
    return filters.keep(fx.listings(spark, d, **parts), *conditions)


@entry("p1_active_default", "SELECT id FROM listings WHERE status = 'active'")
def _(spark, d):
    return plan.matching(fx.listings(spark, d), None, plan.SearchOptions()).select("id")


@entry("p2_rent_range", "SELECT id, rent FROM listings WHERE rent >= 100000 AND rent <= 200000")
def _(spark, d):
    return _filtered(spark, d, filters.between("rent", 10, 20, filters.TEN_THOUSAND_YEN)).select("id", "rent")


@entry(
    "p3_number_ranges",
    """SELECT id, CAST(area AS DOUBLE) AS area, building_age, floor FROM listings
       WHERE area >= 20.5 AND area <= 60 AND building_age >= 3 AND building_age <= 30 AND floor >= 2""",
)
def _(spark, d):
    rows = _filtered(
        spark, d, filters.between("area", 20.5, 60), filters.between("building_age", 3, 30), filters.between("floor", 2)
    )
    return rows.select("id", F.col("area").cast("double").alias("area"), "building_age", "floor")


@entry(
    "p4_multi_select",
    """SELECT id, floor_plan, building_type FROM listings
       WHERE floor_plan IN ('1K', '2LDK', '3LDK', '1LDK', '1DK', '1R') AND building_type IN ('mansion', 'house', 'apartment')""",
)
def _(spark, d):
    rows = _filtered(
        spark, d, filters.one_of("floor_plan", ["1K", "2LDK", "3LDK", "1LDK", "1DK", "1R"]),
        filters.one_of("building_type", ["mansion", "house", "apartment"]),
    )
    return rows.select("id", "floor_plan", "building_type")


@entry(
    "p5_all_facilities",
    "SELECT id FROM listings WHERE list_contains(facilities, 'auto_lock') AND list_contains(facilities, 'elevator')",
)
def _(spark, d):
    return _filtered(spark, d, filters.has_facilities(["auto_lock", "elevator"])).select("id")


EXCLUDED = [ident(k) for k in range(300)]


@entry("p6_exclude_ids", f"SELECT id FROM listings WHERE NOT list_contains({text_list(EXCLUDED)}, id)")
def _(spark, d):
    return filters.without_ids(fx.listings(spark, d), EXCLUDED).select("id")


@entry(
    "p6_exclude_id_table",
    "SELECT id FROM listings WHERE id NOT IN (SELECT property_id FROM marks WHERE mark = 'excluded')",
)
def _(spark, d):
    hidden = fx.marks(spark, d).filter("mark = 'excluded'").select(F.col("property_id").alias("id"))
    return filters.without_ids(fx.listings(spark, d), hidden).select("id")


@entry("p7_nearest_walk", "SELECT id, walk_time FROM listings WHERE walk_time <= 5")
def _(spark, d):
    return _filtered(spark, d, filters.nearest_walk(5), walk=True).select("id", "walk_time")


@entry(
    "p8_yen_predicates",
    """SELECT id FROM listings WHERE rent >= 50000 AND rent <= 300000 AND area >= 10 AND area <= 70
       AND walk_time <= 20 AND floor_plan IN ('1K', '1DK')""",
)
def _(spark, d):
    condition = filters.yen_conditions(50000, 300000, 10, 70, 20, ["1K", "1DK"])
    return _filtered(spark, d, condition, walk=True).select("id")


@entry(
    "p9_user_marks",
    """SELECT id, coalesce(mark, 'none') AS mark FROM listings LEFT JOIN marks ON id = property_id
       WHERE coalesce(mark, 'none') IN ('none', 'candidate')""",
)
def _(spark, d):
    return filters.with_mark(fx.listings(spark, d), fx.marks(spark, d), ["none", "candidate"]).select("id", "mark")


# -------------------------------------------------------------------- joins
@entry(
    "j1_station_named",
    "SELECT id FROM listings l WHERE EXISTS (SELECT 1 FROM stations s WHERE s.property_id = l.id AND contains(s.station_name, 'NATION_1'))",
)
def _(spark, d):
    return joins.station_named(fx.listings(spark, d), fx.stations(spark, d), "NATION_1").select("id")


@entry(
    "j1_station_named_case_free",
    "SELECT id FROM listings l WHERE EXISTS (SELECT 1 FROM stations s WHERE s.property_id = l.id AND contains(s.station_name, 'NATION_1'))",
)
def _(spark, d):
    rows = joins.station_named(fx.listings(spark, d), fx.stations(spark, d), "nátion_1", case_free=True)
    return rows.select("id")


@entry(
    "j2_line_named",
    "SELECT id FROM listings l WHERE EXISTS (SELECT 1 FROM stations s WHERE s.property_id = l.id AND contains(s.line_name, '07'))",
)
def _(spark, d):
    return joins.line_named(fx.listings(spark, d), fx.stations(spark, d), "07").select("id")


@entry(
    "j3_any_station_within",
    "SELECT id FROM listings l WHERE EXISTS (SELECT 1 FROM stations s WHERE s.property_id = l.id AND s.walk_minutes <= 3)",
)
def _(spark, d):
    stations = fx.stations(spark, d, named=False)
    return joins.any_station_within(fx.listings(spark, d), stations, 3).select("id")


@entry(
    "j4_id_sets",
    """SELECT coalesce(a.id, c.id) AS id, CASE WHEN c.id IS NULL THEN 'left' WHEN a.id IS NULL THEN 'right'
              ELSE 'both' END AS side
       FROM (SELECT id FROM listings WHERE status = 'active') a
       FULL JOIN (SELECT DISTINCT id FROM crawl) c ON a.id = c.id""",
)
def _(spark, d):
    return joins.id_sets(scan.active_listings(fx.listings(spark, d)), fx.crawl(spark, d))


@entry(
    "j5_known_and_unseen",
    """SELECT c.detail_url, c.source_property_id IN (SELECT source_property_id FROM listings) AS known
       FROM crawl c""",
)
def _(spark, d):
    key = ["source", "source_property_id"]
    known, unseen = joins.known_and_unseen(fx.crawl(spark, d), fx.listings(spark, d), key)
    known = known.select("detail_url", F.lit(True).alias("known"))
    return known.unionByName(unseen.select("detail_url", F.lit(False).alias("known")))


@entry(
    "j8_match_by_url",
    """SELECT c.detail_url, l.id AS stored_id FROM crawl c LEFT JOIN listings l ON c.detail_url = l.detail_url""",
)
def _(spark, d):
    rows = joins.stored_match(fx.crawl(spark, d), fx.listings(spark, d), ["detail_url"])
    return rows.select("detail_url", "stored_id")


@entry(
    "j9_match_by_source_id",
    f"""SELECT c.source_property_id, l.id AS stored_id, {stamp_sql('l.created_at')} AS stored_created
        FROM crawl c LEFT JOIN listings l ON c.source = l.source AND c.source_property_id = l.source_property_id""",
)
def _(spark, d):
    rows = joins.stored_match(fx.crawl(spark, d), fx.listings(spark, d), ["source", "source_property_id"])
    return rows.select("source_property_id", "stored_id", stamp("stored_created_at").alias("stored_created"))


# -------------------------------------------------------------- sort, pages
SHOWN = {
    "newest": "fetched_at DESC, id DESC",
    "fetched_at_asc": "fetched_at ASC, id ASC",
    "rent_asc": "rent ASC NULLS LAST, id ASC",
    "rent_desc": "rent DESC NULLS LAST, id ASC",
    "area_desc": "area DESC NULLS LAST, id ASC",
    "area_asc": "area ASC NULLS LAST, id ASC",
    "walk_time_asc": "walk_time ASC NULLS LAST, id ASC",
    "building_age_asc": "building_age ASC NULLS LAST, id ASC",
    "building_age_desc": "building_age DESC NULLS LAST, id ASC",
}


def _pages_sql(modes: list[str], limit: int, offset: int = 0) -> str:
    return " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{m}' AS mode, id FROM listings WHERE status = 'active' "
        f"ORDER BY {SHOWN[m]} LIMIT {limit} OFFSET {offset})"
        for m in modes
    )


def _pages(spark, d, modes, limit, offset=None, walk=False):
    active = scan.active_listings(fx.listings(spark, d, walk=walk))
    frames = [paging.page(active, m, limit, offset).select(F.lit(m).alias("mode"), "id") for m in modes]
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


@entry("o1_sort_modes", _pages_sql([m for m in SHOWN if m not in ("area_asc", "building_age_desc")], 100))
def _(spark, d):
    return _pages(spark, d, [m for m in SHOWN if m not in ("area_asc", "building_age_desc")], 100, walk=True)


@entry("o2_added_sort_modes", _pages_sql(["area_asc", "building_age_desc"], 100))
def _(spark, d):
    return _pages(spark, d, ["area_asc", "building_age_desc"], 100)


@entry("o3_limit_offset", _pages_sql(["rent_desc"], 50, 200))
def _(spark, d):
    return _pages(spark, d, ["rent_desc"], None, 200)


CURSOR_TIME = datetime(1999, 6, 1, tzinfo=timezone.utc)
CURSOR = paging.encode_cursor(CURSOR_TIME, ident(5000))


@entry(
    "o4_keyset_page",
    f"""SELECT id, {stamp_sql('fetched_at')} AS fetched,
               translate(to_base64(encode('{{"t":"' || strftime(fetched_at, '%Y-%m-%dT%H:%M:%SZ') || '","id":"' || id || '"}}')),
                         '+/', '-_') AS cursor
        FROM listings
        WHERE status = 'active' AND (fetched_at < TIMESTAMP '1999-06-01'
              OR (fetched_at = TIMESTAMP '1999-06-01' AND id < '{ident(5000)}'))
        ORDER BY fetched_at DESC, id DESC LIMIT 200""",
)
def _(spark, d):
    active = scan.active_listings(fx.listings(spark, d))
    rows = paging.page(active, "newest", 200, offset=30, cursor=CURSOR)
    return rows.select("id", stamp("fetched_at").alias("fetched"), paging.cursor_column().alias("cursor"))


@entry(
    "o5_search_sort",
    """SELECT id FROM (SELECT id, created_at FROM listings WHERE rent <= 150000
       ORDER BY created_at DESC NULLS LAST, id DESC LIMIT 20)""",
)
def _(spark, d):
    condition = filters.yen_conditions(max_rent=150000)
    rows = textsearch.search_page(fx.listings(spark, d), "", fields=[], condition=condition, sort="newest")
    return rows.select("id")


@entry("o6_recent_activity", "SELECT id FROM listings ORDER BY fetched_at DESC, id DESC LIMIT 50")
def _(spark, d):
    return paging.recent(fx.listings(spark, d), "fetched_at", 50, "id").select("id")


@entry(
    "o6_recent_deletions",
    "SELECT property_id, reason FROM delete_logs ORDER BY deleted_at DESC, property_id DESC LIMIT 100",
)
def _(spark, d):
    return paging.recent(fx.delete_logs(spark, d), "deleted_at", 100, "property_id").select("property_id", "reason")


@entry(
    "o6_history_of_listing",
    """SELECT CAST(snapshot_at AS VARCHAR) AS day, rent FROM snapshots WHERE property_id = '7'
       ORDER BY snapshot_at DESC LIMIT 30""",
)
def _(spark, d):
    mine = fx.snapshots(spark, d).filter("property_id = '7'")
    return paging.recent(mine, "snapshot_at", 30).select(F.col("snapshot_at").cast("string").alias("day"), "rent")


@entry("o7_fetched_sample", "SELECT id, title FROM listings ORDER BY updated_at DESC, id DESC LIMIT 10")
def _(spark, d):
    rows = paging.recent(fx.listings(spark, d, title=True), "updated_at", 10, "id")
    return rows.select("id", "title")


# ---------------------------------------------------------------- set union
@entry(
    "u2_set_difference",
    """SELECT (SELECT count(*) FROM (SELECT id FROM crawl EXCEPT SELECT id FROM listings WHERE status = 'active')) AS added,
              (SELECT count(*) FROM (SELECT id FROM listings WHERE status = 'active' EXCEPT SELECT id FROM crawl)) AS gone,
              (SELECT count(*) FROM (SELECT id FROM crawl INTERSECT SELECT id FROM listings WHERE status = 'active')) AS common""",
)
def _(spark, d):
    sides = joins.id_sets(scan.active_listings(fx.listings(spark, d)), fx.crawl(spark, d))
    return sides.agg(
        F.count_if(F.col("side") == "right").alias("added"),
        F.count_if(F.col("side") == "left").alias("gone"),
        F.count_if(F.col("side") == "both").alias("common"),
    )


# ------------------------------------------------------------- whole search
FULL = plan.SearchOptions(
    station="NATION_1", max_walk=30, walk_mode="any", min_rent=5, max_rent=40, rent_unit=filters.TEN_THOUSAND_YEN,
    min_area=10, floor_plans=["1K", "1LDK", "2LDK"], building_types=["apartment", "terrace_house", "mansion"],
    sort="rent_asc", limit=100,
)
FULL_SQL = """FROM listings l WHERE status = 'active' AND rent >= 50000 AND rent <= 400000 AND area >= 10
    AND floor_plan IN ('1K', '1LDK', '2LDK') AND building_type IN ('apartment', 'terrace_house', 'mansion')
    AND EXISTS (SELECT 1 FROM stations s WHERE s.property_id = l.id AND contains(s.station_name, 'NATION_1'))
    AND EXISTS (SELECT 1 FROM stations s WHERE s.property_id = l.id AND s.walk_minutes <= 30)"""


@entry("listing_search", f"SELECT id, title, rent {FULL_SQL} ORDER BY rent ASC NULLS LAST, id LIMIT 100")
def listing_search(spark, d):
    return plan.search(fx.listings(spark, d, title=True), fx.stations(spark, d), FULL).page.select("id", "title", "rent")


@entry("a1_total_before_paging", f"SELECT count(*) AS total {FULL_SQL}")
def _(spark, d):
    return plan.search(fx.listings(spark, d), fx.stations(spark, d), FULL).total


# -------------------------------------------------------------- text search
FIELDS = ["text", "lang", "source"]
TOKENS = {f: f"regexp_split_to_array(lower({f}), '[^\\p{{L}}\\p{{N}}]+')" for f in FIELDS}


def _scored_sql(hit) -> str:
    """Score and rank of documents; hit(field, token) gives the test as SQL."""
    words = ["worthless", "the", "src7"]
    score = " + ".join("CAST(" + " OR ".join(hit(f, w) for f in FIELDS) + " AS INTEGER)" for w in words)
    rank = "CASE " + " ".join(
        f"WHEN {' OR '.join(hit(f, w) for w in words)} THEN {i + 1}" for i, f in enumerate(FIELDS)
    ) + " END"
    return f"SELECT doc_id, lang, source, {score} AS score, {rank} AS best_rank FROM documents"


EXACT_SQL = _scored_sql(lambda f, w: f"list_contains({TOKENS[f]}, '{w}')")


@entry("t1_keyword_search", f"SELECT doc_id, score, best_rank FROM ({EXACT_SQL}) WHERE score > 0")
def _(spark, d):
    rows = textsearch.scored(fx.documents(spark, d), "Worthless, the src7", FIELDS)
    return rows.select("doc_id", "score", "best_rank")


def _listing_sql(words: list[str]) -> str:
    """Score and rank over the weighted listing fields."""
    def hit(f, w):
        return f"list_contains(regexp_split_to_array(lower(coalesce({f}, '')), '[^\\p{{L}}\\p{{N}}]+'), '{w}')"

    score = " + ".join("CAST(" + " OR ".join(hit(f, w) for f in vocab.SEARCH_FIELDS) + " AS INTEGER)" for w in words)
    rank = "CASE " + " ".join(f"WHEN {' OR '.join(hit(f, w) for w in words)} THEN {i + 1}" for i, f in enumerate(vocab.SEARCH_FIELDS)) + " END"
    return f"SELECT id, floor_plan, station, {score} AS score, {rank} AS best_rank FROM listings"


LISTING_WORDS = ["building", "1k", "nation", "detail"]


@entry("t1_listing_fields", f"SELECT id, score, best_rank FROM ({_listing_sql(LISTING_WORDS)}) WHERE score > 0")
def _(spark, d):
    rows = textsearch.scored(fx.listings(spark, d, title=True, place=True), "Building 1K, nation detail", vocab.SEARCH_FIELDS)
    return rows.select("id", "score", "best_rank")


@entry(
    "t2_listing_answer",
    f"""WITH rows AS (SELECT * FROM ({_listing_sql(['building', '2ldk'])}) WHERE score > 0)
        SELECT 'total' AS field, '' AS value, count(*) AS n FROM rows
        UNION ALL SELECT 'floor_plan', floor_plan, count(*) FROM rows GROUP BY floor_plan
        UNION ALL SELECT 'station', station, count(*) FROM rows WHERE station IS NOT NULL GROUP BY station
        UNION ALL SELECT 'hit', id, 1 FROM (SELECT id FROM rows ORDER BY score DESC, best_rank, id LIMIT 20)""",
)
def _(spark, d):
    answer = textsearch.search_answer(fx.listings(spark, d, title=True, place=True), "building 2LDK", vocab.FACET_FIELDS)
    total = answer["total"].select(F.lit("total").alias("field"), F.lit("").alias("value"), F.col("total").alias("n"))
    hits = answer["hits"].select(F.lit("hit").alias("field"), F.col("id").alias("value"), F.lit(1).cast("bigint").alias("n"))
    return total.unionByName(answer["facets"]).unionByName(hits)


@entry(
    "t1_keyword_page",
    f"SELECT doc_id, score, best_rank FROM ({EXACT_SQL}) WHERE score > 0 ORDER BY score DESC, best_rank, doc_id LIMIT 20",
)
def _(spark, d):
    rows = textsearch.search_page(fx.documents(spark, d), "worthless the SRC7", fields=FIELDS, ident="doc_id")
    return rows.select("doc_id", "score", "best_rank")


@entry(
    "t2_search_hits_total_facets",
    f"""WITH rows AS (SELECT * FROM ({EXACT_SQL}) WHERE score > 0 AND lang IN ('en', 'de'))
        SELECT 'total' AS field, '' AS value, count(*) AS n FROM rows
        UNION ALL SELECT 'lang', lang, count(*) FROM rows GROUP BY lang
        UNION ALL SELECT 'source', source, count(*) FROM rows GROUP BY source
        UNION ALL SELECT 'hit', CAST(doc_id AS VARCHAR), 1 FROM (
            SELECT doc_id FROM rows ORDER BY score DESC, best_rank, doc_id LIMIT 30 OFFSET 10)""",
)
def _(spark, d):
    answer = textsearch.search_answer(
        fx.documents(spark, d), "worthless the src7", ["lang", "source"], limit=30, offset=10, fields=FIELDS,
        ident="doc_id", condition=F.col("lang").isin("en", "de"),
    )
    total = answer["total"].select(F.lit("total").alias("field"), F.lit("").alias("value"), F.col("total").alias("n"))
    hits = answer["hits"].select(
        F.lit("hit").alias("field"), F.col("doc_id").cast("string").alias("value"), F.lit(1).cast("bigint").alias("n")
    )
    return total.unionByName(answer["facets"]).unionByName(hits)


@entry("t3_empty_query", "SELECT doc_id FROM documents")
def _(spark, d):
    return textsearch.scored(fx.documents(spark, d), "  ", FIELDS).select("doc_id")


@entry("t4_hit_rows", "SELECT id, title, rent, CAST(area AS DOUBLE) AS area, '' AS station, status FROM listings")
def _(spark, d):
    hits = files.json_rows(fx.listings(spark, d, title=True), "id", "title", "rent", "area", "status")
    rows = textsearch.hit_rows(hits, "json")
    return rows.select("id", "title", "rent", F.col("area").cast("double").alias("area"), "station", "status")


def _near_sql(f: str, w: str) -> str:
    edits = textsearch.allowed_edits(w)
    # levenshtein counts bytes here, so letters outside ASCII become one byte each
    plain = "regexp_replace(t, '[^a-z0-9]', '#', 'g')"
    near = f"OR (abs(length(t) - {len(w)}) <= {edits} AND levenshtein({plain}, '{w}') <= {edits})" if edits else ""
    prefix = f"OR starts_with(t, '{w}')" if w == "tionl" else ""
    return f"(len([t FOR t IN {TOKENS[f]} IF t = '{w}' {near} {prefix}]) > 0)"


_TYPO_WORDS = ["wortless", "heed", "tionl"]
_TYPO_SCORE = " + ".join(
    "CAST(" + " OR ".join(_near_sql(f, w) for f in FIELDS) + " AS INTEGER)" for w in _TYPO_WORDS
)


@entry("t5_typos_and_prefix", f"SELECT * FROM (SELECT doc_id, {_TYPO_SCORE} AS score FROM documents) WHERE score > 0")
def _(spark, d):
    rows = textsearch.scored(fx.documents(spark, d), " ".join(_TYPO_WORDS), FIELDS, typos=True, prefix_last=True)
    return rows.select("doc_id", "score")


# ------------------------------------------------------------------- facets
@entry(
    "a9_facets_of_hits",
    """SELECT 'floor_plan' AS field, floor_plan AS value, count(*) AS n FROM listings WHERE rent <= 200000 GROUP BY 2
       UNION ALL SELECT 'station', station, count(*) FROM listings WHERE rent <= 200000 AND station IS NOT NULL GROUP BY 2""",
)
def _(spark, d):
    rows = filters.keep(fx.listings(spark, d, place=True), filters.yen_conditions(max_rent=200000))
    return facets.facets(rows)


@entry(
    "a10_facets_of_all",
    """SELECT 'building_type' AS field, building_type AS value, count(*) AS n FROM listings GROUP BY 2
       UNION ALL SELECT 'rent', CAST(rent AS VARCHAR), count(*) FROM listings WHERE rent IS NOT NULL GROUP BY 2""",
)
def _(spark, d):
    return facets.facets(fx.listings(spark, d), ["building_type", "rent"])


# --------------------------------------------------------------- crawl diff
LAST = ["fetched_at"]


@entry(
    "m6_crawl_diff",
    """SELECT coalesce(a.id, c.id) AS id,
              CASE WHEN a.id IS NULL THEN 'new' WHEN c.id IS NULL THEN 'removed'
                   WHEN a.title IS DISTINCT FROM c.title OR a.rent IS DISTINCT FROM c.rent
                        OR a.image_url IS DISTINCT FROM c.image_url THEN 'updated' ELSE 'same' END AS kind
       FROM (SELECT * FROM listings WHERE status = 'active') a FULL JOIN crawl c ON a.id = c.id""",
)
def _(spark, d):
    return diff.crawl_diff(fx.listings(spark, d, title=True), fx.crawl(spark, d, title=True), LAST)


@entry(
    "m6_crawl_diff_in_scope",
    """SELECT coalesce(a.id, c.id) AS id,
              CASE WHEN a.id IS NULL THEN 'new' WHEN c.id IS NULL THEN 'removed'
                   WHEN a.rent IS DISTINCT FROM c.rent THEN 'updated' ELSE 'same' END AS kind
       FROM (SELECT * FROM listings WHERE status = 'active') a FULL JOIN crawl c ON a.id = c.id
       WHERE c.id IS NOT NULL OR a.floor_plan = '1K'""",
)
def _(spark, d):
    return diff.crawl_diff(
        fx.listings(spark, d), fx.crawl(spark, d), LAST, scope=F.col("floor_plan") == "1K", compared=["rent"]
    )


@entry(
    "a13_batch_result",
    """WITH k AS (SELECT CASE WHEN a.id IS NULL THEN 'new' WHEN c.id IS NULL THEN 'removed'
                         WHEN a.rent IS DISTINCT FROM c.rent THEN 'updated' ELSE 'same' END AS kind
               FROM (SELECT * FROM listings WHERE status = 'active') a FULL JOIN crawl c ON a.id = c.id)
       SELECT kind AS metric, count(*) AS value FROM k WHERE kind <> 'same' GROUP BY kind
       UNION ALL SELECT 'scraped', count(*) FROM crawl UNION ALL SELECT 'errors', 0""",
)
def _(spark, d):
    crawl = fx.crawl(spark, d)
    return diff.batch_result(diff.crawl_diff(fx.listings(spark, d), crawl, LAST, compared=["rent"]), crawl)
