"""Column functions on URLs, titles, attributes and texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsubo import vocab
from tsubo.functions import attributes, text, urls
from tsubo.operators import joins, lookup, telemetry
from tsubo.plans.catalog.base import entry, values_rows
from tsubo.sources import fixtures as fx


def listed(column):
    return F.array_join(column, ",")


# --------------------------------------------------------------------- URLs
BARE = "regexp_replace(url, '[?#].*$', '')"


@entry(
    "f1_url_storage_form",
    f"SELECT page_id, 'https://' || regexp_replace(regexp_replace({BARE}, '/$', ''), '^[a-z]+://', '') AS form FROM pages",
)
def _(spark, d):
    return fx.pages(spark, d).select("page_id", urls.storage_form(F.col("url")).alias("form"))


@entry(
    "f2_url_crawl_form",
    f"""SELECT page_id, regexp_replace({BARE}, '(.)/$', '\\1') AS form FROM pages
        UNION ALL SELECT order_key, detail_url || '/' FROM listings""",
)
def _(spark, d):
    detail = fx.listings(spark, d).select(
        F.col("order_key").alias("page_id"), F.concat("detail_url", F.lit("/?from=list#photo")).alias("url")
    )
    rows = fx.pages(spark, d).select("page_id", "url").unionByName(detail)
    return rows.select("page_id", urls.crawl_form(F.col("url")).alias("form"))


@entry("f3_url_existence_form", f"SELECT page_id, regexp_replace({BARE}, '/$', '') AS form FROM pages")
def _(spark, d):
    return fx.pages(spark, d).select("page_id", urls.existence_form(F.col("url")).alias("form"))


def _addresses(spark, d):
    """Detail addresses with usable ids, and page addresses without."""
    return fx.crawl(spark, d).select(F.concat("detail_url", F.lit("/?x=1")).alias("url")).unionByName(
        fx.pages(spark, d).select("url")
    )


ADDRESSES = "SELECT detail_url || '/?x=1' AS url, true AS detail FROM crawl UNION ALL SELECT url, false FROM pages"


@entry(
    "f4_source_id",
    f"""SELECT url, CASE WHEN detail THEN replace(replace(url, 'https://listings.example/rent/detail/', ''), '/?x=1', '')
                         ELSE md5(url) END AS source_id FROM ({ADDRESSES})""",
)
def _(spark, d):
    return _addresses(spark, d).select("url", urls.source_id(F.col("url")).alias("source_id"))


@entry("f5_listing_id", "SELECT source_property_id, md5(source || ':' || source_property_id) AS made FROM crawl")
def _(spark, d):
    return fx.crawl(spark, d).select(
        "source_property_id", urls.listing_id(F.col("source"), F.col("source_property_id")).alias("made")
    )


@entry("f6_legacy_id", "SELECT order_key, md5(detail_url) AS made FROM listings")
def _(spark, d):
    url = F.concat(F.replace("detail_url", F.lit("https"), F.lit("http")), F.lit("/?q=1#x"))
    return fx.listings(spark, d).select("order_key", urls.legacy_id(url).alias("made"))


@entry(
    "f7_id_kind",
    f"SELECT url, detail AS extracted, NOT detail AS refresh FROM ({ADDRESSES})",
)
def _(spark, d):
    ident = urls.source_id(F.col("url"))
    return _addresses(spark, d).select(
        "url",
        urls.has_page_id(ident).alias("extracted"),
        urls.needs_id_refresh(F.lit(fx.SOURCE), ident, fx.SOURCE).alias("refresh"),
    )


@entry(
    "u3_first_positions",
    f"""SELECT 'https://' || regexp_replace(regexp_replace({BARE}, '/$', ''), '^[a-z]+://', '') AS url,
               min(page_id) AS first_position FROM pages GROUP BY 1""",
)
def _(spark, d):
    return joins.first_positions(fx.pages(spark, d), urls.storage_form(F.col("url")), "page_id")


# ------------------------------------------------------------------- titles
@entry("f8_clean_title", "SELECT order_key, name AS title FROM raw_attributes")
def _(spark, d):
    return fx.raw_attributes(spark, d).select("order_key", text.clean_title(F.col("raw_title")).alias("title"))


@entry("f9_clean_title_in_table", "SELECT order_key, name AS title FROM raw_attributes")
def _(spark, d):
    return fx.raw_attributes(spark, d).select("order_key", text.clean_title_in_table(F.col("raw_title")).alias("title"))


@entry(
    "p10_dirty_titles",
    "SELECT order_key % 6 AS form, count(*) AS n, CASE WHEN order_key % 6 = 5 THEN 0 ELSE count(*) END AS dirty FROM raw_attributes GROUP BY 1",
)
def _(spark, d):
    return (
        fx.raw_attributes(spark, d)
        .groupBy((F.col("order_key") % 6).alias("form"))
        .agg(F.count("*").alias("n"), F.count_if(text.is_dirty_title(F.col("raw_title"))).alias("dirty"))
    )


# --------------------------------------------------------------- attributes
PLAN_SQL = """CASE raw_layout WHEN 'ワンルーム' THEN '1R' WHEN '洋室6 1K' THEN '1K' WHEN '洋室6 LDK10 2LDK' THEN '2LDK'
    WHEN '4DK+1K' THEN '1K' ELSE raw_layout END"""
TYPE_SQL = """CASE WHEN raw_structure IN ('鉄筋コンクリート', 'SRC') THEN 'mansion'
    WHEN raw_structure IN ('木造', '軽量鉄骨', '鉄骨造') THEN 'apartment'
    WHEN raw_kind = 'マンション' THEN 'mansion' WHEN raw_kind = 'アパート' THEN 'apartment'
    WHEN raw_kind = '一戸建て' THEN 'house' WHEN raw_kind = 'テラスハウス' THEN 'terrace_house' ELSE lower(raw_kind) END"""


@entry("f10_floor_plan", f"SELECT order_key, {PLAN_SQL} AS floor_plan FROM raw_attributes")
def _(spark, d):
    rows = fx.raw_attributes(spark, d)
    return rows.select("order_key", attributes.floor_plan(F.col("raw_layout")).alias("floor_plan"))


@entry("f11_building_type", f"SELECT order_key, {TYPE_SQL} AS building_type FROM raw_attributes")
def _(spark, d):
    kind = attributes.building_type(F.col("raw_kind"), F.col("raw_structure"))
    return fx.raw_attributes(spark, d).select("order_key", kind.alias("building_type"))


CODE_ROWS = values_rows(vocab.FACILITY_CODES)
KEYS_OF_CODES = f"""SELECT order_key, list_sort(list(DISTINCT t.v)) AS keys
    FROM (SELECT order_key, unnest(codes) AS code FROM raw_attributes) r
    JOIN {CODE_ROWS} t(k, v) ON r.code = t.k GROUP BY order_key"""


@entry(
    "f12_facility_codes",
    f"""SELECT r.order_key, CASE WHEN r.order_key % 9 = 0 THEN 'not json'
               WHEN c.keys IS NULL THEN '' ELSE '["' || array_to_string(c.keys, '","') || '"]' END AS keys
        FROM raw_attributes r LEFT JOIN ({KEYS_OF_CODES}) c ON r.order_key = c.order_key""",
)
def _(spark, d):
    keys = attributes.facility_codes_text(F.col("raw_codes"))
    return fx.raw_attributes(spark, d).select("order_key", keys.alias("keys"))


LABEL_ROWS = values_rows(vocab.FACILITY_LABELS)
KEYS_OF_LABELS = f"""SELECT order_key, list_sort(list(DISTINCT v)) AS keys FROM (
    SELECT order_key, label, arg_max(v, {{'exact': label = k, 'size': length(k)}}) AS v
    FROM (SELECT order_key, unnest(raw_labels) AS label FROM raw_attributes) r
    JOIN {LABEL_ROWS} t(k, v) ON contains(r.label, t.k) GROUP BY order_key, label) GROUP BY order_key"""


@entry("f13_facility_labels", f"SELECT order_key, array_to_string(keys, ',') AS keys FROM ({KEYS_OF_LABELS})")
def _(spark, d):
    keys = attributes.label_keys(F.col("raw_labels"))
    return fx.raw_attributes(spark, d).select("order_key", listed(keys).alias("keys"))


@entry(
    "u1_merged_keys",
    f"""SELECT a.order_key, array_to_string(list_sort(list_distinct(list_concat(coalesce(c.keys, []), a.keys))), ',') AS keys
        FROM ({KEYS_OF_LABELS}) a LEFT JOIN ({KEYS_OF_CODES}) c ON a.order_key = c.order_key""",
)
def _(spark, d):
    keys = attributes.merge_keys(
        attributes.facility_keys(F.col("codes")), attributes.label_keys(F.col("raw_labels")), F.array(F.lit(""))
    )
    return fx.raw_attributes(spark, d).select("order_key", listed(keys).alias("keys"))


@entry(
    "j10_named_codes",
    f"""SELECT t.v AS name, count(*) AS n FROM (SELECT unnest(codes) AS code FROM raw_attributes) r
        JOIN {CODE_ROWS} t(k, v) ON r.code = t.k GROUP BY 1""",
)
def _(spark, d):
    named = lookup.named(spark, fx.raw_attributes(spark, d).select("codes"), "codes", "facility_codes")
    return named.groupBy("name").agg(F.count("*").alias("n"))


# ---------------------------------------------------------- texts to values
MAN = "(CAST(yen // 10000 AS VARCHAR) || '.' || CAST(yen // 1000 % 10 AS VARCHAR))"


@entry(
    "f14_rent_from_text",
    f"""SELECT order_key, CASE WHEN rent BETWEEN 10000 AND 10000000 THEN rent END AS rent FROM (
            SELECT order_key, CASE WHEN order_key % 2 = 0 THEN CAST(trunc(CAST({MAN} AS DOUBLE) * 10000) AS INTEGER)
                                   ELSE yen END AS rent FROM raw_attributes)""",
)
def _(spark, d):
    return fx.raw_texts(spark, d).select("order_key", text.rent(F.col("page_text")).alias("rent"))


@entry(
    "f15_floor_plan_from_text",
    f"""SELECT order_key, list_extract(['1LDK', '3DK', NULL, '2SLDK'], order_key % 4 + 1) AS floor_plan
        FROM raw_attributes""",
)
def _(spark, d):
    return fx.raw_texts(spark, d).select("order_key", text.floor_plan(F.col("page_text")).alias("floor_plan"))


@entry(
    "f16_numbers_from_text",
    """SELECT order_key, CASE WHEN square_metres + 0.5 BETWEEN 5 AND 500 THEN CAST(square_metres + 0.5 AS DOUBLE) END AS area,
              CASE WHEN minutes BETWEEN 1 AND 60 THEN minutes END AS walk,
              CASE WHEN years BETWEEN 0 AND 100 THEN years END AS age, storey AS floor FROM raw_attributes""",
)
def _(spark, d):
    t = F.col("page_text")
    return fx.raw_texts(spark, d).select(
        "order_key",
        text.area(t).alias("area"),
        text.walk_minutes(t).alias("walk"),
        text.building_age(t).alias("age"),
        text.floor(t).alias("floor"),
    )


WARD = "list_extract(['新宿区', '渋谷区', '港区', '目黒区'], order_key % 4 + 1)"


@entry("f17_station_from_text", f"SELECT order_key, '　' || {WARD} || '中央駅' AS station FROM raw_attributes")
def _(spark, d):
    return fx.raw_texts(spark, d).select("order_key", text.station(F.col("page_text")).alias("station"))


@entry(
    "f18_address_from_text",
    f"""SELECT order_key, CASE WHEN order_key % 6 <> 5 THEN
               list_extract(['東京都', '大阪府', '神奈川県', '千葉県', '埼玉県', ''], order_key % 6 + 1) || {WARD}
                    || '本町' || repeat('あ', CAST(order_key % 60 AS INTEGER)) END AS address
        FROM raw_attributes""",
)
def _(spark, d):
    return fx.raw_texts(spark, d).select("order_key", text.address(F.col("page_text")).alias("address"))


@entry(
    "f19_unescape",
    "SELECT order_key, name || '/東' AS decoded, name || '\"' AS kept FROM raw_attributes",
)
def _(spark, d):
    number = F.col("order_key").cast("string")
    escaped = F.concat(F.lit("\\u30e1\\u30be\\u30f3"), number, F.lit("\\/\\u6771"))
    broken = F.concat(F.lit("メゾン"), number, F.lit('"'))
    return fx.raw_attributes(spark, d).select(
        "order_key", text.unescape_json(escaped).alias("decoded"), text.unescape_json(broken).alias("kept")
    )


@entry(
    "f20_rent_and_change_labels",
    f"""SELECT order_key, CASE WHEN rent <> 0 THEN ((rent + 500) // 1000 // 10) || '.' || ((rent + 500) // 1000 % 10) END AS man,
               coalesce(t.v, 'other') AS label
        FROM listings LEFT JOIN {values_rows(vocab.CHANGE_LABELS)} t(k, v)
             ON t.k = CASE WHEN order_key % 2 = 0 THEN 'rent_changed' WHEN order_key % 3 = 0 THEN 'new_property' ELSE 'other' END""",
)
def _(spark, d):
    k = F.col("order_key")
    kind = F.when(k % 2 == 0, "rent_changed").when(k % 3 == 0, "new_property").otherwise("other")
    return fx.listings(spark, d).select(
        "order_key", attributes.rent_label(F.col("rent")).alias("man"), attributes.change_label(kind).alias("label")
    )


@entry("f21_facility_list", "SELECT order_key, array_to_string(codes, ',') AS items FROM raw_attributes")
def _(spark, d):
    stored = F.when(F.col("order_key") % 2 == 0, F.to_json("codes")).otherwise(F.array_join("codes", " / "))
    return fx.raw_attributes(spark, d).select("order_key", listed(attributes.facility_list(stored)).alias("items"))


@entry(
    "f22_facility_names",
    f"""SELECT f.key, coalesce(t.v, f.key) AS name, count(*) AS n
        FROM (SELECT unnest(facilities) AS key FROM listings) f
        LEFT JOIN {values_rows(vocab.FACILITY_NAMES)} t(k, v) ON f.key = t.k GROUP BY 1, 2""",
)
def _(spark, d):
    keys = fx.listings(spark, d).select(F.explode("facilities").alias("key"))
    named = keys.select("key", attributes.facility_name(F.col("key")).alias("name"))
    return named.groupBy("key", "name").agg(F.count("*").alias("n"))


SECONDS = f"(epoch_us(TIMESTAMP '{fx.EVENTS_AS_OF}') - epoch_us(ts)) // 1000000"


@entry(
    "f23_age_label",
    f"""SELECT event_id, CASE WHEN {SECONDS} // 86400 > 0 THEN ({SECONDS} // 86400) || '日前'
               WHEN {SECONDS} // 3600 > 0 THEN ({SECONDS} // 3600) || '時間前'
               WHEN {SECONDS} // 60 > 0 THEN ({SECONDS} // 60) || '分前' ELSE '今' END AS age FROM events""",
)
def _(spark, d):
    as_of = F.lit(fx.EVENTS_AS_OF).cast("timestamp")
    events = fx.table(spark, d, "events")
    return events.select("event_id", attributes.age_label(F.col("ts"), as_of).alias("age"))


DAYS = f"coalesce(datediff('hour', last_seen_at, TIMESTAMP '{fx.LISTINGS_AS_OF}') // 24, 9999)"


@entry(
    "f24_days_since_seen",
    f"SELECT id, {DAYS} AS days, {DAYS} >= 7 AS likely, {DAYS} >= 14 AS probably FROM listings",
)
def _(spark, d):
    seen, as_of = F.col("last_seen_at"), F.lit(fx.LISTINGS_AS_OF)
    return fx.listings(spark, d).select(
        "id",
        attributes.days_since_seen(seen, as_of).alias("days"),
        attributes.is_likely_expired(seen, as_of).alias("likely"),
        attributes.is_probably_expired(seen, as_of).alias("probably"),
    )


@entry(
    "f25_retry_delay",
    """SELECT event_id, list_extract([300, 900, 3600, 14400, 43200], least(event_id % 8, 4) + 1) AS seconds FROM events""",
)
def _(spark, d):
    delay = attributes.retry_delay_seconds(F.col("event_id") % 8)
    return fx.table(spark, d, "events").select("event_id", delay.alias("seconds"))


@entry(
    "f26_squeeze",
    "SELECT doc_id, md5(regexp_replace('　 ' || text, '[\\s\\x{3000}\\x{A0}\\x{85}\\x{2028}]+', ' ', 'g')) AS squeezed FROM documents",
)
def _(spark, d):
    squeezed = text.squeeze(F.concat(F.lit("　 "), "text"))
    return fx.documents(spark, d).select("doc_id", F.md5(squeezed).alias("squeezed"))


@entry(
    "w9_hour_band",
    """SELECT event_id, CASE WHEN hour(ts) >= 22 OR hour(ts) < 6 THEN 20 WHEN hour(ts) >= 9 AND hour(ts) < 18 THEN 5
              ELSE 10 END AS allowance FROM events""",
)
def _(spark, d):
    band = telemetry.hour_band(F.col("ts"), night=(22, 6, 20), day=(9, 18, 5), default=10)
    return fx.table(spark, d, "events").select("event_id", band.alias("allowance"))
