"""Merges, soft deletes, backfills and retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsubo.operators import diff, keyed, retention, upsert
from tsubo.plans.catalog.base import entry, stamp, stamp_sql
from tsubo.plans.catalog.values import PLAN_SQL, TYPE_SQL
from tsubo.sources import files
from tsubo.sources import fixtures as fx

AS_OF = f"TIMESTAMP '{fx.LISTINGS_AS_OF}'"
URL = ["detail_url"]


def _merge_sql(status: str, removed_at: str) -> str:
    return f"""SELECT coalesce(l.detail_url, c.detail_url) AS detail_url, coalesce(l.id, c.id) AS id,
        CASE WHEN c.id IS NULL THEN l.rent ELSE c.rent END AS rent,
        CASE WHEN c.id IS NULL OR l.id IS NULL THEN coalesce(l.status, c.status) ELSE {status} END AS status,
        {stamp_sql(f"CASE WHEN c.id IS NULL OR l.id IS NULL THEN coalesce(l.removed_at, c.removed_at) ELSE {removed_at} END")}
            AS removed,
        {stamp_sql('coalesce(l.created_at, c.created_at)')} AS created
        FROM listings l FULL JOIN crawl c ON l.detail_url = c.detail_url"""


LAST = ["fetched_at"]


def _merged(frame):
    return frame.select(
        "detail_url", "id", "rent", "status", stamp("removed_at").alias("removed"), stamp("created_at").alias("created")
    )


@entry("m1_upsert_keeping_status", _merge_sql("l.status", "l.removed_at"))
def _(spark, d):
    incoming = upsert.prepared(fx.crawl(spark, d))
    return _merged(upsert.upsert(fx.listings(spark, d), incoming, URL, LAST, keep_status=True))


@entry("m3_upsert_reviving", _merge_sql("c.status", "c.removed_at"))
def m3_upsert_reviving(spark, d):
    incoming = upsert.prepared(fx.crawl(spark, d))
    return _merged(upsert.upsert(fx.listings(spark, d), incoming, URL, LAST))


@entry(
    "m4_upsert_some_columns",
    f"""SELECT coalesce(l.detail_url, c.detail_url) AS detail_url, coalesce(l.id, c.id) AS id,
               CASE WHEN c.id IS NULL THEN l.rent ELSE c.rent END AS rent, coalesce(l.status, c.status) AS status,
               coalesce(l.source_property_id, c.source_property_id) AS source_property_id
        FROM listings l FULL JOIN crawl c ON l.detail_url = c.detail_url""",
)
def _(spark, d):
    merged = upsert.upsert(fx.listings(spark, d), fx.crawl(spark, d), URL, LAST, only=upsert.LEGACY_COLUMNS)
    return merged.select("detail_url", "id", "rent", "status", "source_property_id")


def _new_stations(spark, d):
    """Stations the crawl brought along: every fifth listing has two."""
    rows = fx.crawl(spark, d).filter(F.col("order_key") % 5 == 0)
    pair = F.array(
        F.struct(F.lit("Alpha").alias("station_name"), F.lit(1).alias("sort_order")),
        F.struct(F.lit("Beta").alias("station_name"), F.lit(2).alias("sort_order")),
    )
    return rows.select(F.col("id").alias("property_id"), F.inline(pair))


def _children_sql(touched: str) -> str:
    return f"""SELECT property_id, station_name, CAST(sort_order AS INTEGER) AS sort_order FROM stations
        WHERE property_id NOT IN (SELECT id FROM crawl WHERE {touched})
        UNION ALL SELECT id, unnest(['Alpha', 'Beta']), unnest([1, 2]) FROM crawl WHERE order_key % 5 = 0"""


@entry("m2_children_kept_when_empty", _children_sql("order_key % 5 = 0"))
def _(spark, d):
    stored = fx.stations(spark, d, ordered=True).select("property_id", "station_name", "sort_order")
    return upsert.replace_children(stored, _new_stations(spark, d), fx.crawl(spark, d))


@entry("m3_children_replaced", _children_sql("true"))
def _(spark, d):
    stored = fx.stations(spark, d, ordered=True).select("property_id", "station_name", "sort_order")
    return upsert.replace_children(stored, _new_stations(spark, d), fx.crawl(spark, d), replace_empty=True)


@entry(
    "m5_soft_delete",
    f"""SELECT id, CASE WHEN gone THEN 'removed' ELSE status END AS status,
               {stamp_sql(f"CASE WHEN gone THEN {AS_OF} ELSE removed_at END")} AS removed
        FROM (SELECT *, status = 'active' AND id NOT IN (SELECT id FROM crawl) AS gone FROM listings)""",
)
def _(spark, d):
    listings = fx.listings(spark, d)
    gone = diff.crawl_diff(listings, fx.crawl(spark, d), LAST, compared=["rent"]).filter("kind = 'removed'")
    return upsert.soft_delete(listings, gone, fx.LISTINGS_AS_OF).select("id", "status", stamp("removed_at").alias("removed"))


@entry(
    "m7_touch_seen",
    f"""SELECT id, {stamp_sql(f"CASE WHEN source_property_id IN (SELECT source_property_id FROM crawl) THEN {AS_OF} ELSE last_seen_at END")} AS seen
        FROM listings""",
)
def _(spark, d):
    key = ["source", "source_property_id"]
    rows = upsert.touch(fx.listings(spark, d), fx.crawl(spark, d), key, fx.LISTINGS_AS_OF)
    return rows.select("id", stamp("last_seen_at").alias("seen"))


@entry(
    "m16_backfill",
    f"""SELECT l.order_key, CASE WHEN l.order_key % 2 = 0 THEN l.source_property_id
                    ELSE lpad(CAST(l.order_key AS VARCHAR), 40, '0') END AS source_property_id,
               {PLAN_SQL} AS floor_plan, {TYPE_SQL} AS building_type,
               {stamp_sql('coalesce(l.last_seen_at, l.updated_at)')} AS seen
        FROM listings l JOIN raw_attributes r ON l.order_key = r.order_key""",
)
def _(spark, d):
    raw = fx.raw_attributes(spark, d).select(
        "order_key", F.col("raw_layout").alias("floor_plan"), F.col("raw_kind").alias("building_type"),
        F.col("raw_structure").alias("structure"),
    )
    stored = fx.listings(spark, d).drop("floor_plan", "building_type").join(raw, "order_key")
    ident = F.when(F.col("order_key") % 2 == 0, F.col("source_property_id")).otherwise("")
    rows = upsert.backfilled(stored.withColumn("source_property_id", ident))
    return rows.select("order_key", "source_property_id", "floor_plan", "building_type", stamp("last_seen_at").alias("seen"))


@entry(
    "w10_latest_per_key",
    "SELECT o_custkey AS owner, arg_max(o_orderkey, {'d': o_orderdate, 'k': o_orderkey}) AS order_key FROM orders GROUP BY 1",
)
def _(spark, d):
    rows = fx.table(spark, d, "orders").select(
        F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("order_key"), "o_orderdate"
    )
    return keyed.latest(rows, ["owner"], ["o_orderdate", "order_key"]).select("owner", "order_key")


# ---------------------------------------------------------------- retention
EXPIRED = f"status = 'removed' AND removed_at < {AS_OF} - INTERVAL 90 DAY"


@entry("m11_expired", f"SELECT id FROM listings WHERE {EXPIRED}")
def _(spark, d):
    return retention.expired(fx.listings(spark, d), fx.LISTINGS_AS_OF).select("id")


@entry(
    "m12_retention_run",
    f"""SELECT id, CASE WHEN {EXPIRED} THEN 'deleted' ELSE 'kept' END AS outcome,
               CASE WHEN {EXPIRED} THEN 'expired_90_days' ELSE '' END AS reason FROM listings""",
)
def _(spark, d):
    listings = fx.listings(spark, d, title=True)
    run = retention.apply_retention(listings, fx.LISTINGS_AS_OF)
    kept = run.remaining.select("id", F.lit("kept").alias("outcome"), F.lit("").alias("reason"))
    return kept.unionByName(run.log.select(F.col("property_id").alias("id"), F.lit("deleted").alias("outcome"), "reason"))


# -------------------------------------------------------------- search index
@entry(
    "s7_index_after_save",
    """SELECT coalesce(l.id, c.id) AS id, 'put' AS action, CAST(c.rent AS VARCHAR) AS rent, c.status
       FROM crawl c LEFT JOIN listings l ON l.detail_url = c.detail_url""",
)
def _(spark, d):
    """Only the listings of a save go to the index, under their stored id."""
    crawl = fx.crawl(spark, d)
    saved = upsert.upsert(fx.listings(spark, d), upsert.prepared(crawl), URL, LAST).join(crawl.select(*URL), URL, "left_semi")
    rows = files.index_updates(saved, saved.filter(F.lit(False)))
    field = lambda name: F.get_json_object("document", f"$.{name}").alias(name)
    return rows.select("id", "action", field("rent"), field("status"))


@entry("s7_index_after_retention", f"SELECT id, 'delete' AS action FROM listings WHERE {EXPIRED}")
def _(spark, d):
    listings = fx.listings(spark, d, title=True)
    run = retention.apply_retention(listings, fx.LISTINGS_AS_OF)
    return files.index_updates(listings.filter(F.lit(False)), run.listed).select("id", "action")
