"""Typed rows out of pages. The expected values come from the order columns the
pages were written from, not from a second parser."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsubo import schemas, vocab
from tsubo.functions import text
from tsubo.operators import pages
from tsubo.plans import ingest
from tsubo.plans.catalog.base import entry
from tsubo.plans.catalog.values import KEYS_OF_CODES, PLAN_SQL, TYPE_SQL, listed
from tsubo.session import written
from tsubo.sources import fixtures as fx

CRAWLED = "2001-08-02 00:00:00"
ADDRESS = """CASE WHEN order_key % 5 = 0 THEN 'https' ELSE 'http' END || '://listings.example/rent/detail/'
    || lpad(CAST(order_key AS VARCHAR), 44, '0') || '/'"""
WARD = "list_extract(['新宿区', '渋谷区', '港区', '目黒区'], {} % 4 + 1)"
HAS_STATE = "order_key % 3 <> 1"


@entry(
    "x1_listed_urls",
    """SELECT c_custkey AS page_id, pos, 'https://realestate.yahoo.co.jp/rent/detail/' || CASE WHEN pos = 0
              THEN '_0000' || lpad(CAST(c_custkey AS VARCHAR), 40, 'a') ELSE lpad(CAST(c_custkey AS VARCHAR), 40, 'b') END AS url
       FROM customer CROSS JOIN (VALUES (0), (1)) p(pos)""",
)
def _(spark, d):
    return pages.listed_urls(fx.list_pages(spark, d))


@entry(
    "x1_linked_urls",
    """SELECT page_id, url, row_number() OVER (PARTITION BY page_id ORDER BY min(place)) - 1 AS pos FROM (
           SELECT page_id, place, regexp_replace(regexp_replace(link, '[?#].*$', ''),
                                              '^((?:[a-z]+://[^/]*)?/.+)/$', '\\1') AS url FROM (
               SELECT page_id, unnest(links) AS link, generate_subscripts(links, 1) AS place FROM (
                   SELECT page_id, regexp_extract_all(html, '<a\\b[^>]*\\bhref\\s*=\\s*["'']([^"'']*)["'']', 1) AS links
                   FROM pages)))
       GROUP BY page_id, url""",
)
def _(spark, d):
    found = pages.linked_urls(fx.pages(spark, d))
    return found.select("page_id", "url", F.col("pos").cast("bigint").alias("pos"))


def _unescaped(expr: str) -> str:
    for entity, char in text.ENTITIES:
        expr = f"replace({expr}, '{entity}', '{char.replace(chr(39), chr(39) * 2)}')"
    return expr


@entry(
    "x2_titles_of_pages",
    f"""SELECT page_id, trim({_unescaped("regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}) AS title FROM pages""",
)
def _(spark, d):
    return fx.pages(spark, d).select("page_id", pages.page_title(F.col("html")).alias("title"))


@entry(
    "x2_clean_titles",
    """SELECT order_key AS page_id, CASE WHEN order_key % 4 = 0 OR order_key % 3 <> 0 THEN name
              WHEN order_key % 6 = 3 THEN 'No Title' ELSE '部屋' || order_key END AS title FROM raw_attributes""",
)
def _(spark, d):
    return fx.detail_pages(spark, d).select("page_id", pages.cleaned_page_title(F.col("html")).alias("title"))


@entry("x3_canonical_address", f"SELECT order_key AS page_id, {ADDRESS} AS address FROM raw_attributes")
def _(spark, d):
    rows = fx.detail_pages(spark, d)
    return rows.select("page_id", pages.page_address(F.col("url"), F.col("html")).alias("address"))


@entry(
    "x4_page_state",
    f"""SELECT order_key AS page_id, yen AS price, square_metres * 100 + 25 AS area, storey AS floor, minutes, years,
               raw_kind AS kind, nullif(raw_structure, '') AS structure, raw_layout AS layout,
               '["' || array_to_string(codes, '","') || '"]' AS codes,
               'https://img.example/' || order_key || '.png' AS image
        FROM raw_attributes WHERE {HAS_STATE}""",
)
def _(spark, d):
    rows = pages.with_state(fx.detail_pages(spark, d).filter(pages.has_state(F.col("html"))))
    s = "state."
    return rows.select(
        "page_id",
        F.col(s + "Price").alias("price"),
        F.col(s + "MonopolyArea").alias("area"),
        F.col(s + "FloorNum").alias("floor"),
        F.col(s + "MinutesFromStation").alias("minutes"),
        F.col(s + "YearsOld").alias("years"),
        F.col(s + "KindName").alias("kind"),
        F.col(s + "StructureName").alias("structure"),
        F.col(s + "RoomLayoutBreakdown").alias("layout"),
        F.col(s + "Facilities").alias("codes"),
        F.col(s + "RoomLayoutImageUrl").alias("image"),
    )


@entry(
    "x5_state_columns",
    f"""SELECT r.order_key AS page_id, yen AS rent, CAST(square_metres + 0.25 AS DOUBLE) AS area,
               nullif(minutes, 0) AS walk_time, storey AS floor, years AS building_age, 'メゾン' || r.order_key AS building_name,
               '東京都' || {WARD.format('r.order_key')} AS address, {WARD.format('r.order_key')} || '駅' AS station,
               '南' AS direction, {PLAN_SQL} AS floor_plan, {TYPE_SQL} AS building_type, storey || '階' AS floor_label,
               coalesce(array_to_string(c.keys, ','), '') AS facilities, 'ac,al' AS features
        FROM raw_attributes r LEFT JOIN ({KEYS_OF_CODES}) c ON r.order_key = c.order_key WHERE r.{HAS_STATE}""",
)
def _(spark, d):
    names = [
        "rent", "walk_time", "floor", "building_age", "building_name", "address", "station", "direction",
        "floor_plan", "building_type", "floor_label",
    ]
    fields = pages.state_fields()
    rows = pages.with_state(fx.detail_pages(spark, d).filter(pages.has_state(F.col("html"))))
    return rows.select(
        "page_id",
        *[fields[n].alias(n) for n in names],
        fields["area"].cast("double").alias("area"),
        listed(fields["facilities"]).alias("facilities"),
        listed(fields["features"]).alias("features"),
    )


@entry(
    "x6_text_columns",
    """SELECT order_key AS page_id, CASE WHEN minutes BETWEEN 1 AND 60 THEN minutes END AS walk_time,
              CASE WHEN years BETWEEN 1 AND 100 THEN years END AS building_age,
              CASE WHEN square_metres + 0.5 BETWEEN 5 AND 500 THEN CAST(square_metres + 0.5 AS DOUBLE) END AS area
       FROM raw_attributes WHERE order_key % 3 = 1""",
)
def _(spark, d):
    without_state = fx.detail_pages(spark, d).filter(~pages.has_state(F.col("html")))
    rows = without_state.withColumn("page_text", text.visible_text(F.col("html")))
    fields = pages.text_fields(F.col("page_text"))
    return rows.select(
        "page_id",
        fields["walk_time"].alias("walk_time"),
        fields["building_age"].alias("building_age"),
        fields["area"].cast("double").alias("area"),
    )


ACCESS = f"""SELECT order_key AS page_id, {WARD.format('order_key')} || '駅' AS station_name, '東西 線' AS line_name,
        CASE WHEN order_key % 130 BETWEEN 1 AND 120 THEN CAST(order_key % 130 AS INTEGER) ELSE 0 END AS walk_minutes, 1 AS sort_order
    FROM raw_attributes
    UNION ALL SELECT order_key, {WARD.format('(order_key + 1)')} || '駅', '南北線', 0, 2 FROM raw_attributes"""


@entry("x7_access_rows", ACCESS)
def _(spark, d):
    return pages.access_rows(fx.detail_pages(spark, d))


@entry(
    "x8_first_station",
    f"""SELECT order_key AS page_id, {WARD.format('order_key')} || '駅' AS station,
               CASE WHEN order_key % 130 BETWEEN 1 AND 120 THEN CAST(order_key % 130 AS INTEGER)
                    ELSE 777 END AS walk_time FROM raw_attributes""",
)
def _(spark, d):
    rows = fx.detail_pages(spark, d)
    listings = rows.select(
        "page_id", pages.page_access(F.col("html")).alias("access"), F.lit("").alias("station"), F.lit(777).alias("walk_time")
    )
    return pages.with_first_station(listings).drop("access")


PICTURE = "'https://realestate-pctr.c.yimg.jp/' || rpad(CAST(order_key AS VARCHAR), 110, 'a')"


@entry(
    "x9_page_images",
    f"""SELECT order_key AS page_id, {PICTURE} || rpad('one', 100, 'b') || repeat('x', 100) AS image_url, 0 AS sort_order
        FROM raw_attributes WHERE order_key % 7 <> 0
        UNION ALL SELECT order_key, {PICTURE} || rpad('one', 100, 'b'), 1 FROM raw_attributes WHERE order_key % 7 <> 0
        UNION ALL SELECT order_key, {PICTURE} || rpad('two', 100, 'c'), 2 FROM raw_attributes WHERE order_key % 7 <> 0
        UNION ALL SELECT order_key, 'https://img.example/og' || order_key || '.jpg', 0
        FROM raw_attributes WHERE order_key % 7 = 0""",
)
def _(spark, d):
    return pages.image_rows(fx.detail_pages(spark, d))


@entry(
    "u4_distinct_images",
    """WITH p AS (SELECT order_key, 'https://realestate-pctr.c.yimg.jp/' || rpad(CAST(order_key AS VARCHAR), 110, 'a') AS picture FROM raw_attributes)
       SELECT order_key AS page_id, unnest(range(2)) AS pos,
              unnest([picture || rpad('one', 100, 'b') || repeat('x', 100), picture || rpad('two', 100, 'c')]) AS url
       FROM p WHERE order_key % 7 <> 0""",
)
def _(spark, d):
    found = F.regexp_extract_all("html", F.lit(vocab.IMAGE_URL_PATTERN), 0)
    kept = pages.distinct_images(found, by_signature=True)
    rows = fx.detail_pages(spark, d).select("page_id", F.posexplode(kept).alias("pos", "url"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@entry(
    "x10_section_labels",
    """SELECT order_key AS page_id, 'オートロック,' || CASE WHEN order_key % 2 = 0 THEN 'ペット可' ELSE '2階以上' END AS labels
       FROM raw_attributes""",
)
def _(spark, d):
    rows = pages.section_labels(fx.detail_pages(spark, d))
    return rows.select("page_id", listed(F.col("labels")).alias("labels"))


@entry(
    "x11_category_labels",
    """SELECT order_key AS page_id, 'シャワー,トイレ,風呂,' || CASE WHEN order_key % 2 = 0 THEN 'ガスコンロ' ELSE 'システムキッチン' END AS labels
       FROM raw_attributes""",
)
def _(spark, d):
    labels = pages.category_labels(text.visible_text(F.col("html")))
    return fx.detail_pages(spark, d).select("page_id", listed(labels).alias("labels"))


@entry(
    "pages_to_listings",
    f"""SELECT lpad(CAST(order_key AS VARCHAR), 44, '0') AS source_property_id, {ADDRESS} AS detail_url,
               CASE WHEN order_key % 4 = 0 OR order_key % 3 <> 0 THEN name WHEN order_key % 6 = 3 THEN name
                    ELSE '部屋' || order_key END AS title,
               CASE WHEN {HAS_STATE} THEN yen END AS state_rent,
               {WARD.format('order_key')} || '駅' AS station, {HAS_STATE} AS with_facilities
        FROM raw_attributes""",
)
def pages_to_listings(spark, d):
    rows = ingest.split(ingest.page_rows(fx.detail_pages(spark, d), fx.SOURCE, CRAWLED)).listings
    by_state = F.col("building_name").isNotNull()
    return rows.select(
        "source_property_id",
        "detail_url",
        "title",
        F.when(by_state, F.col("rent")).alias("state_rent"),
        "station",
        (F.size(F.coalesce("facilities", F.array().cast("array<string>"))) > 0).alias("with_facilities"),
    )


@entry(
    "pages_to_stored_tables",
    """WITH p AS (SELECT *, order_key % 2 = 0 AS known FROM raw_attributes)
       SELECT 'listings' AS part, CAST(count(*) AS BIGINT) AS n FROM p
       UNION ALL SELECT 'kept_created', count(*) FILTER (known) FROM p
       UNION ALL SELECT 'stations', 2 * count(*) FROM p
       UNION ALL SELECT 'images', count(*) FILTER (order_key % 7 = 0) + 3 * count(*) FILTER (order_key % 7 <> 0) FROM p
       UNION ALL SELECT 'new_property', count(*) FROM p""",
)
def _(spark, d):
    """Pages merged into a table that already holds every second listing."""
    rows = written(ingest.page_rows(fx.detail_pages(spark, d), fx.SOURCE, CRAWLED), "page-rows")
    old = rows.filter(F.col("page_id") % 2 == 0).withColumn("created_at", F.lit("1999-01-01").cast("timestamp"))
    stored = schemas.conform(ingest.split(old).listings, "properties")
    nothing = {t: schemas.empty(spark, t) for t in ("property_stations", "property_images", "property_snapshots")}
    after = ingest.store(ingest.split(rows), stored, *nothing.values(), CRAWLED)
    kept = after.listings.filter(F.year("created_at") == 1999)
    new = after.changes.filter("change_type = 'new_property'")
    parts = {"listings": after.listings, "kept_created": kept, "stations": after.stations, "images": after.images,
             "new_property": new}
    counts = [frame.agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name, frame in parts.items()]
    return functools.reduce(DataFrame.unionByName, counts)
