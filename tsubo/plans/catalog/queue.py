"""Work queue states and windows over the request log."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsubo.operators import joins, queue, scan, telemetry
from tsubo.plans.catalog.base import entry, stamp, stamp_sql
from tsubo.sources import fixtures as fx

AS_OF = f"TIMESTAMP '{fx.EVENTS_AS_OF}'"
KEY = ["source", "source_property_id"]
BUSY = f"""SELECT source_property_id FROM queue WHERE status IN ('pending', 'processing')
    OR (status = 'done' AND updated_at > {AS_OF} - INTERVAL 12 HOUR)"""


@entry(
    "w3_next_items",
    f"""SELECT id, status FROM queue WHERE status = 'pending' OR (status = 'failed' AND next_retry_at <= {AS_OF})
        ORDER BY CASE WHEN status = 'pending' THEN 0 ELSE 1 END, priority DESC, created_at, id LIMIT 50""",
)
def _(spark, d):
    return queue.next_items(fx.queue(spark, d), fx.EVENTS_AS_OF, 50).select("id", "status")


@entry("j6_free_to_enqueue", f"SELECT id FROM listings WHERE source_property_id NOT IN ({BUSY})")
def _(spark, d):
    return queue.free_to_enqueue(fx.listings(spark, d), fx.queue(spark, d), fx.EVENTS_AS_OF).select("id")


@entry(
    "m13_enqueue_unseen",
    """WITH found AS (SELECT DISTINCT lpad(CAST(order_key AS VARCHAR), 40, '0') AS k FROM listings WHERE order_key % 3 <> 0),
       stored AS (SELECT lpad(CAST(order_key AS VARCHAR), 40, '0') AS k FROM listings WHERE order_key % 4 = 0),
       unseen AS (SELECT k FROM found WHERE k NOT IN (SELECT k FROM stored)),
       items AS (SELECT *, lpad(source_property_id, 40, '0') AS k FROM queue)
       SELECT k, CASE WHEN status = 'failed' AND k IN (SELECT k FROM unseen) THEN 'pending' ELSE status END AS status,
              CASE WHEN status = 'failed' AND k IN (SELECT k FROM unseen) THEN 0 ELSE attempts END AS attempts, priority
       FROM items
       UNION ALL SELECT k, 'pending', 0, 0 FROM unseen WHERE k NOT IN (SELECT k FROM items)""",
)
def m13_enqueue_unseen(spark, d):
    listings = fx.listings(spark, d)
    padded = F.lpad(F.col("source_property_id"), 40, "0")
    found = listings.filter(F.col("order_key") % 3 != 0).select(F.concat("detail_url", F.lit("/?list=1")).alias("url"))
    stored = listings.filter(F.col("order_key") % 4 == 0).withColumn("source_property_id", padded)
    items = fx.queue(spark, d).withColumn("source_property_id", padded)
    rows = queue.enqueue_unseen(items, found, stored, fx.EVENTS_AS_OF, fx.SOURCE)
    return rows.select(F.col("source_property_id").alias("k"), "status", "attempts", "priority")


@entry(
    "m14_daily_reenqueue",
    f"""SELECT source_property_id, detail_url, 'pending' AS status, 1 AS priority, 0 AS attempts FROM listings
        WHERE status = 'active' AND source_property_id NOT IN ({BUSY})""",
)
def _(spark, d):
    rows = queue.reenqueue(fx.listings(spark, d), fx.queue(spark, d), fx.EVENTS_AS_OF)
    return rows.select("source_property_id", "detail_url", "status", "priority", "attempts")


OUTCOMES_SQL = """SELECT user_id AS id, event_id AS seq, ts AS tried, event_type <> 'error' AS ok,
        CASE WHEN event_type <> 'error' THEN '' WHEN event_id % 4 = 0 THEN 'status code 404' WHEN event_id % 4 = 1 THEN 'WAF page'
             ELSE 'timeout' END AS error FROM events"""


def outcomes(events):
    k = F.col("event_id")
    failed = F.col("event_type") == "error"
    error = F.when(~failed, "").when(k % 4 == 0, "status code 404").when(k % 4 == 1, "WAF page").otherwise("timeout")
    return events.select(
        F.col("user_id").alias("id"), k.alias("seq"), F.col("ts").alias("at"), (~failed).alias("ok"), error.alias("error")
    )


def fresh_queue(items):
    """The queue as it was before any attempt."""
    return items.withColumns(
        {
            "attempts": F.lit(0), "status": F.lit("pending"), "last_error": F.lit(""),
            "next_retry_at": F.lit(None).cast("timestamp"), "completed_at": F.lit(None).cast("timestamp"),
        }
    )


def queue_shown(rows):
    return rows.select(
        "id", "status", "attempts", "last_error",
        stamp("next_retry_at").alias("retry"), stamp("completed_at").alias("completed"), stamp("updated_at").alias("updated"),
    )


OUTCOMES_RESULT = f"""WITH o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY tried, seq) AS n FROM ({OUTCOMES_SQL})),
    k AS (SELECT *, CASE WHEN ok THEN 'done' WHEN contains(error, '404') THEN 'permanent_fail'
                 WHEN contains(error, 'WAF') THEN 'blocked' WHEN n >= 5 THEN 'spent' ELSE 'retry' END AS kind FROM o),
    r AS (SELECT id, max(n) AS n, arg_max(kind, n) AS kind, arg_max(tried, n) AS tried, arg_max(error, n) AS error,
                 arg_max(tried, n) FILTER (kind IN ('done', 'permanent_fail', 'spent')) AS ended FROM k GROUP BY id)
    SELECT id, CASE WHEN kind IN ('done', 'permanent_fail') THEN kind ELSE 'failed' END AS status,
           CAST(n AS INTEGER) AS attempts,
           CASE kind WHEN 'done' THEN '' WHEN 'permanent_fail' THEN '404 Not Found (permanent): ' || error
                WHEN 'blocked' THEN 'WAF/circuit breaker: ' || error
                WHEN 'spent' THEN 'Max retries exceeded (' || n || '): ' || error ELSE error END AS last_error,
           {stamp_sql("CASE WHEN kind = 'blocked' THEN tried + INTERVAL 1 HOUR WHEN kind = 'retry' THEN tried + to_seconds(list_extract([300, 900, 3600, 14400, 43200], least(n, 5))) END")} AS retry,
           {stamp_sql('ended')} AS completed, {stamp_sql('tried')} AS updated
    FROM r"""


@entry("m15_apply_outcomes", OUTCOMES_RESULT)
def _(spark, d):
    tried = outcomes(fx.table(spark, d, "events"))
    return queue_shown(queue.apply_outcomes(fresh_queue(fx.queue(spark, d)), tried, ("at", "seq")))


# ------------------------------------------------------------------ windows
LIMITS = {"minute": 2, "hour": 4, "day": 20}
TRAILING = {
    w: f"count(*) OVER (PARTITION BY key ORDER BY ts RANGE BETWEEN INTERVAL {s} SECOND - INTERVAL 1 MICROSECOND PRECEDING AND CURRENT ROW)"
    for w, s in telemetry.WINDOWS.items()
}


@entry(
    "w4_trailing_counts",
    "SELECT id, last_minute, last_hour, last_day, "
    + ", ".join(f"greatest({n} - last_{w}, 0) AS remaining_{w}" for w, n in LIMITS.items())
    + " FROM (SELECT id, "
    + ", ".join(f"{c} AS last_{w}" for w, c in TRAILING.items())
    + " FROM requests)",
)
def w4_trailing_counts(spark, d):
    return telemetry.trailing_counts(fx.requests(spark, d), LIMITS).drop("key", "ts")


@entry(
    "w4_usage_at",
    f"""SELECT key, last_hour, last_day, greatest(4 - last_hour, 0) AS remaining_hour, greatest(20 - last_day, 0) AS remaining_day,
               least(round(100.0 * last_hour / 4, 2), 100) AS percent_hour, least(round(100.0 * last_day / 20, 2), 100) AS percent_day
        FROM (SELECT key, count(*) FILTER (ts > TIMESTAMP '2024-01-20' - INTERVAL 1 HOUR) AS last_hour,
                     count(*) FILTER (ts > TIMESTAMP '2024-01-20' - INTERVAL 1 DAY) AS last_day
              FROM requests WHERE ts <= TIMESTAMP '2024-01-20' GROUP BY key)""",
)
def _(spark, d):
    windows = {w: telemetry.WINDOWS[w] for w in ("hour", "day")}
    return telemetry.usage_at(fx.requests(spark, d), "2024-01-20 00:00:00", LIMITS, windows)


@entry("w5_hourly_usage", f"SELECT id, {TRAILING['hour']} AS last_hour FROM requests")
def _(spark, d):
    rows = telemetry.trailing_counts(fx.requests(spark, d), {}, {"hour": 3600})
    return rows.select("id", "last_hour")


RECENT = "avg(CAST(failed AS INTEGER)) OVER (PARTITION BY key ORDER BY ts, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"


@entry("w6_recent_failure_rate", f"SELECT id, round({RECENT}, 6) AS recent_rate FROM requests")
def w6_recent_failure_rate(spark, d):
    rows = telemetry.recent_failure_rate(fx.requests(spark, d))
    return rows.select("id", F.round("recent_rate", 6).alias("recent_rate"))


COUNTED = """SELECT *, row_number() OVER w AS n, sum(CAST(failed AS INTEGER)) OVER w AS failures
    FROM requests WINDOW w AS (PARTITION BY key ORDER BY ts, id)"""
STREAKS = f"""SELECT *, n - coalesce(max(CASE WHEN NOT failed THEN n END) OVER (PARTITION BY key ORDER BY n), 0) AS streak
    FROM ({COUNTED})"""


@entry(
    "w7_failure_streak",
    f"SELECT id, streak, failed AND streak >= 2 AND status_code IN (500, 429, 403) AS streak_block FROM ({STREAKS})",
)
def w7_failure_streak(spark, d):
    return telemetry.progress(fx.requests(spark, d)).select("id", "streak", "streak_block")


@entry(
    "w8_cumulative_rate",
    f"""SELECT id, n, CAST(failures AS BIGINT) AS failures, round(failures / n, 6) AS failure_rate,
               failed AND n >= 20 AND failures / n >= 0.4 AS rate_block FROM ({COUNTED})""",
)
def _(spark, d):
    rows = telemetry.progress(fx.requests(spark, d))
    return rows.select("id", "n", "failures", F.round("failure_rate", 6).alias("failure_rate"), "rate_block")


@entry(
    "m17_block_state",
    f"""WITH l AS (SELECT key, max({{'t': ts, 'i': id}}) FILTER (NOT failed) AS last FROM requests GROUP BY key),
        o AS (SELECT r.*, r.failed AND (l.last IS NULL OR {{'t': r.ts, 'i': r.id}} > l.last) AS open
              FROM requests r JOIN l ON r.key = l.key),
        s AS (SELECT key, count(*) FILTER (open) AS failure_count, count(*) FILTER (NOT failed) AS success_count,
                     max(ts) AS last_attempt, max(ts) FILTER (NOT failed) AS last_success,
                     max(ts) FILTER (open AND status_code IN (500, 429, 403)) AS block_at,
                     arg_max(status_code, {{'t': ts, 'i': id}}) FILTER (open AND status_code IN (500, 429, 403)) AS blocked_code
              FROM o GROUP BY key)
        SELECT key, block_at IS NOT NULL AS is_blocked, {stamp_sql('block_at + INTERVAL 1 HOUR')} AS blocked_until, blocked_code,
               {stamp_sql('last_attempt')} AS last_attempt, {stamp_sql('last_success')} AS last_success,
               failure_count, success_count,
               block_at IS NULL OR TIMESTAMP '2024-01-30 12:00:00' > block_at + INTERVAL 1 HOUR AS can_run FROM s""",
)
def _(spark, d):
    rows = telemetry.block_state(fx.requests(spark, d), "2024-01-30 12:00:00")
    return rows.withColumns({c: stamp(c) for c in ("blocked_until", "last_attempt", "last_success")})


@entry(
    "u2_known_split_counts",
    """SELECT count(*) FILTER (source_property_id IN (SELECT source_property_id FROM listings WHERE status = 'active')) AS known,
              count(*) FILTER (source_property_id NOT IN (SELECT source_property_id FROM listings WHERE status = 'active')) AS unseen
       FROM queue""",
)
def _(spark, d):
    known, unseen = joins.known_and_unseen(
        fx.queue(spark, d).select(*KEY), scan.active_listings(fx.listings(spark, d)), KEY
    )
    flags = known.withColumn("known", F.lit(True)).unionByName(unseen.withColumn("known", F.lit(False)))
    return flags.agg(F.count_if("known").alias("known"), F.count_if(~F.col("known")).alias("unseen"))
