"""Stream jobs run over the tables as file streams until the data ends. Each has
the SQL of its batch form, so stream and batch must agree."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsubo.plans.catalog.base import entry, stamp, stamp_sql
from tsubo.plans.catalog.queue import OUTCOMES_RESULT, RECENT, STREAKS, fresh_queue, outcomes, queue_shown
from tsubo.session import work_dir
from tsubo.sources import fixtures as fx
from tsubo.streaming import jobs


def _requests(spark, d):
    codes = F.array(F.lit(500), F.lit(429), F.lit(403), F.lit(404))
    events = jobs.file_stream(spark, d, "events")
    return fx.request_rows(events, F.col("event_type") == "error", codes)


@entry(
    "r1_window_counts",
    f"""SELECT key, {stamp_sql("time_bucket(INTERVAL 1 HOUR, ts)")} AS start, count(*) AS n,
               count(*) FILTER (failed) AS failed FROM requests GROUP BY key, time_bucket(INTERVAL 1 HOUR, ts)""",
)
def _(spark, d):
    root = work_dir(spark, "window-counts")
    jobs.finish(jobs.write_counts(_requests(spark, d), root))
    return jobs.read_counts(spark, root, "1 hour").select("key", stamp("start").alias("start"), "n", "failed")


@entry(
    "r1_sliding_counts",
    f"""SELECT key, {stamp_sql("time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * i")} AS start, count(*) AS n
        FROM requests, (VALUES (0), (1)) s(i)
        GROUP BY key, time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE * i""",
)
def _(spark, d):
    root = work_dir(spark, "sliding-counts")
    jobs.finish(jobs.write_counts(_requests(spark, d), root))
    return jobs.read_counts(spark, root, "1 hour", "30 minutes").select("key", stamp("start").alias("start"), "n")


@entry(
    "r2_streak_and_recent_rate",
    f"""SELECT s.id, n, CAST(failures AS BIGINT) AS failures, streak, recent_rate FROM ({STREAKS}) s
        JOIN (SELECT id, round({RECENT}, 6) AS recent_rate FROM requests) r ON s.id = r.id""",
)
def _(spark, d):
    root = work_dir(spark, "progress")
    jobs.finish(jobs.write_progress(_requests(spark, d), root))
    rows = jobs.read_progress(spark, root)
    return rows.select("id", "n", "failures", "streak", F.round("recent_rate", 6).alias("recent_rate"))


@entry("r3_queue_states", OUTCOMES_RESULT)
def _(spark, d):
    root = work_dir(spark, "queue-states")
    jobs.finish(jobs.write_outcomes(outcomes(jobs.file_stream(spark, d, "events")), root, ("at", "seq")))
    return queue_shown(jobs.read_queue(fresh_queue(fx.queue(spark, d)), root))


@entry(
    "r4_change_feed",
    """WITH s AS (
           SELECT property_id, snapshot_at, rent, lag(rent) OVER (PARTITION BY property_id ORDER BY snapshot_at) AS old FROM (
               SELECT CAST(l_partkey AS VARCHAR) AS property_id, CAST(l_shipdate AS DATE) AS snapshot_at,
                      arg_max(CAST(floor(l_extendedprice / 20000) * 20000 AS BIGINT),
                              {'o': l_orderkey * 10 + l_linenumber, 'p': l_extendedprice}) AS rent
               FROM lineitem GROUP BY 1, 2))
       SELECT property_id, CAST(snapshot_at AS VARCHAR) AS day,
              CASE WHEN old IS NULL THEN 'new_property' ELSE 'rent_changed' END AS change_type,
              CASE WHEN old IS NULL THEN 'New property detected' ELSE CAST(rent AS VARCHAR) END AS new_value
       FROM s WHERE rent IS DISTINCT FROM old""",
)
def _(spark, d):
    root = work_dir(spark, "change-feed")
    rent = (F.floor(F.col("l_extendedprice") / 20000) * 20000).cast("bigint")
    raw = jobs.file_stream(spark, d, "lineitem").select(
        F.col("l_partkey").cast("string").alias("property_id"), F.to_date("l_shipdate").alias("snapshot_at"),
        rent.alias("rent"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), "l_extendedprice",
    )
    order = ["line", "l_extendedprice"]
    jobs.finish(jobs.write_snapshots(raw, root, order))
    rows = jobs.read_changes(spark, root)
    return rows.select("property_id", F.col("snapshot_at").cast("string").alias("day"), "change_type", "new_value")


@entry("r5_distinct_events", "SELECT id, status_code FROM requests")
def _(spark, d):
    root = work_dir(spark, "distinct")
    twice = _requests(spark, d).withColumn("_copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_copy")
    jobs.finish(jobs.write_distinct(twice, root, ["id"]))
    return jobs.read_rows(spark, root).select("id", "status_code")
