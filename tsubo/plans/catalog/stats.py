"""Counts, histograms, quality and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsubo import vocab
from tsubo.functions import urls
from tsubo.operators import history, stats
from tsubo.plans.catalog.base import entry, stamp, stamp_sql
from tsubo.sources import fixtures as fx

AS_OF = f"TIMESTAMP '{fx.LISTINGS_AS_OF}'"
EVENTS_AS_OF = f"TIMESTAMP '{fx.EVENTS_AS_OF}'"


@entry(
    "a2_listing_counts",
    """SELECT count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'removed') AS removed,
              count(*) FILTER (status IN ('active', 'removed')) AS total FROM listings""",
)
def _(spark, d):
    return stats.listing_counts(fx.listings(spark, d))


@entry(
    "a3_recent_counts",
    f"""SELECT 'fetched_last_24h' AS metric, count(*) FILTER (fetched_at >= {AS_OF} - INTERVAL 24 HOUR) AS value FROM listings
        UNION ALL SELECT 'changes_last_7_days', count(*) FILTER (snapshot_at >= {AS_OF} - INTERVAL 7 DAY) FROM change_log""",
)
def _(spark, d):
    changes = history.change_log(history.compared_days(fx.snapshots(spark, d)))
    changes = changes.withColumn("detected_at", F.col("snapshot_at").cast("timestamp"))
    return stats.recent_counts(fx.listings(spark, d), changes, fx.LISTINGS_AS_OF)


@entry("a4_snapshot_total", "SELECT count(*) AS total FROM snapshots")
def _(spark, d):
    return stats.total(fx.snapshots(spark, d))


@entry(
    "a5_top_stations",
    """SELECT station, count(*) AS n FROM listings WHERE status = 'active' AND station IS NOT NULL AND station <> ''
       GROUP BY station ORDER BY n DESC, station LIMIT 20""",
)
def _(spark, d):
    return stats.top_stations(fx.listings(spark, d, place=True))


@entry(
    "a6_rent_histogram",
    " UNION ALL ".join(
        f"""SELECT '{label}' AS range_label, {low} AS min_rent, {high} AS max_rent,
            count(*) FILTER (status = 'active' AND rent >= {low} AND rent < {high}) AS n FROM listings"""
        for label, low, high in vocab.RENT_BINS
    ),
)
def _(spark, d):
    return stats.rent_histogram(fx.listings(spark, d))


@entry(
    "a7_queue_counts",
    " UNION ALL ".join(
        f"SELECT '{s}' AS status, count(*) FILTER (status = '{s}') AS n FROM queue" for s in vocab.QUEUE_STATUSES
    ),
)
def _(spark, d):
    return stats.queue_counts(fx.queue(spark, d))


@entry(
    "a8_deletion_stats",
    f"""SELECT 'total_deleted' AS metric, count(*) AS value FROM delete_logs
        UNION ALL SELECT 'deleted_last_30_days', count(*) FILTER (deleted_at >= {AS_OF} - INTERVAL 30 DAY) FROM delete_logs
        UNION ALL SELECT 'reason_' || reason, count(*) FROM delete_logs GROUP BY reason
        UNION ALL SELECT 'currently_removed', count(*) FROM listings WHERE status = 'removed'
        UNION ALL SELECT 'expired_ready_for_deletion', count(*) FROM listings
            WHERE status = 'removed' AND removed_at < {AS_OF} - INTERVAL 90 DAY""",
)
def _(spark, d):
    return stats.deletion_stats(fx.delete_logs(spark, d), fx.listings(spark, d), fx.LISTINGS_AS_OF)


@entry(
    "a11_id_quality",
    f"""SELECT count(*) AS total, count(*) FILTER (good) AS extracted, count(*) FILTER (NOT good) AS fallback,
               CAST(0 AS BIGINT) AS missing, {stamp_sql('min(made) FILTER (NOT good)')} AS oldest,
               {stamp_sql('max(made) FILTER (NOT good)')} AS newest
        FROM (SELECT order_key % 4 <> 3 AS good, created_at AS made FROM listings)""",
)
def _(spark, d):
    plain = F.concat(F.lit("https://listings.example/other/"), F.col("order_key").cast("string"))
    address = F.when(F.col("order_key") % 4 == 3, plain).otherwise(F.col("detail_url"))
    rows = fx.listings(spark, d).withColumn("source_property_id", urls.source_id(address))
    return stats.id_quality(rows).select(
        "total", "extracted", "fallback", "missing",
        stamp("oldest_fallback").alias("oldest"), stamp("newest_fallback").alias("newest"),
    )


@entry(
    "a12_duplicate_keys",
    "SELECT 'demo' AS source, o_custkey AS owner, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1",
)
def _(spark, d):
    rows = fx.table(spark, d, "orders").select(F.lit("demo").alias("source"), F.col("o_custkey").alias("owner"))
    return stats.duplicate_keys(rows, ["source", "owner"])


@entry(
    "a14_log_health",
    f"""WITH r AS (SELECT * FROM requests WHERE ts > {EVENTS_AS_OF} - INTERVAL 120 HOUR AND ts <= {EVENTS_AS_OF}),
        c AS (SELECT count(*) FILTER (NOT failed) AS success, count(*) FILTER (status_code = 404) AS breaker_open,
                     count(*) FILTER (status_code = 429) AS waf, count(*) FILTER (status_code = 403) AS status_403,
                     count(*) FILTER (status_code = 429) AS status_429, count(*) FILTER (status_code = 500) AS status_500
              FROM r)
        SELECT *, breaker_open + waf + status_403 + status_429 AS blocks,
               breaker_open + waf + status_403 + status_429 = 0 AS passed FROM c""",
)
def _(spark, d):
    code = F.col("status_code").cast("string")
    line = (
        F.when(~F.col("failed"), F.concat(F.lit("Successfully scraped "), F.col("id").cast("string"), F.lit("th")))
        .when(F.col("status_code") == 404, "CIRCUIT BREAKER OPEN: too many errors")
        .when(F.col("status_code") == 429, F.concat(F.lit("WAF answered, status="), code))
        .otherwise(F.concat(F.lit("answer "), code, F.lit(" from host")))
    )
    lines = fx.requests(spark, d).select("ts", line.alias("line"))
    return stats.log_health(lines, fx.EVENTS_AS_OF, hours=120)


@entry(
    "a15_page_quality",
    """SELECT total, no_title, no_station, round(100.0 * no_title / total, 1) AS no_title_pct,
              round(100.0 * no_station / total, 1) AS no_station_pct,
              no_title / total < 0.05 AND no_station / total < 0.2 AS passed
       FROM (SELECT count(*) AS total, count(*) FILTER (order_key % 29 = 0) AS no_title,
                    count(*) FILTER (coalesce(station, '') = '') AS no_station FROM listings)""",
)
def _(spark, d):
    title = F.when(F.col("order_key") % 29 == 0, vocab.NO_TITLE).otherwise(F.col("title"))
    return stats.page_quality(fx.listings(spark, d, title=True, place=True).withColumn("title", title))


def _grade(value: str, levels: tuple) -> str:
    return f"CASE WHEN {value} >= {levels[1]} THEN 'danger' WHEN {value} >= {levels[0]} THEN 'warn' ELSE 'ok' END"


@entry(
    "a16_queue_kpis",
    f"""SELECT pending, {_grade('pending', vocab.PENDING_LEVELS)} AS pending_grade, hours AS oldest_hours,
               {_grade('hours', vocab.OLDEST_PENDING_HOURS)} AS oldest_grade, round(lost, 4) AS permanent_fail_rate,
               {_grade('lost', vocab.PERMANENT_FAIL_RATE)} AS permanent_fail_grade
        FROM (SELECT count(*) FILTER (status = 'pending') AS pending,
                     coalesce((epoch_us({EVENTS_AS_OF}) - epoch_us(min(created_at) FILTER (status = 'pending'))) // 3600000000, 0) AS hours,
                     coalesce(count(*) FILTER (status = 'permanent_fail') / count(*), 0) AS lost FROM queue)""",
)
def _(spark, d):
    return stats.queue_kpis(fx.queue(spark, d), fx.EVENTS_AS_OF)


@entry(
    "a17_candidate_count",
    """SELECT count(*) AS marked, count(*) FILTER (o_orderstatus <> 'F') AS marked_listings
       FROM orders WHERE o_orderkey % 5 = 0""",
)
def _(spark, d):
    active = fx.listings(spark, d).filter("status = 'active'")
    return stats.marked_count(active, fx.marks(spark, d))
