"""Snapshots, as-of lookups, change log and child order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsubo.operators import history, joins, paging
from tsubo.plans.catalog.base import entry
from tsubo.sources import fixtures as fx

DAY = "1998-07-01"


def _day(column: str = "snapshot_at"):
    return F.col(column).cast("string").alias("day")


@entry(
    "w1_previous_values",
    """SELECT property_id, CAST(snapshot_at AS VARCHAR) AS day, CASE WHEN p_day IS NULL THEN 1 ELSE
              CAST(rent <> p_rent AS INTEGER) + CAST(area <> p_area AS INTEGER) + CAST(floor_plan <> p_plan AS INTEGER)
              + CAST(status <> p_status AS INTEGER) END AS n_changes FROM compared""",
)
def _(spark, d):
    rows = history.compared_days(fx.snapshots(spark, d))
    return rows.select("property_id", _day(), F.size("changes").alias("n_changes"))


@entry("w2_child_order", "SELECT property_id, station_name, line_name, walk_minutes, sort_order FROM stations")
def _(spark, d):
    rows = fx.stations(spark, d, ordered=True)
    return rows.select(
        "property_id", "station_name", "line_name", "walk_minutes", F.col("sort_order").cast("bigint").alias("sort_order")
    )


@entry(
    "j7_previous_snapshot",
    f"""SELECT p_partkey AS part, CAST(max(snapshot_at) AS VARCHAR) AS day, arg_max(rent, snapshot_at) AS rent
        FROM part LEFT JOIN snapshots ON CAST(p_partkey AS VARCHAR) = property_id AND snapshot_at < DATE '{DAY}'
        GROUP BY p_partkey""",
)
def _(spark, d):
    parts = fx.table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("id"))
    rows = joins.previous_snapshot(parts, fx.snapshots(spark, d), f"{DAY} 00:00:00")
    return rows.select(F.col("p_partkey").alias("part"), _day("previous.snapshot_at"), F.col("previous.rent").alias("rent"))


@entry(
    "m8_one_per_day",
    """SELECT property_id, day, rent, line FROM (
           SELECT CAST(l_partkey AS VARCHAR) AS property_id, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS day,
                  CAST(floor(l_extendedprice) AS BIGINT) AS rent, l_orderkey * 10 + l_linenumber AS line,
                  row_number() OVER (PARTITION BY l_partkey, CAST(l_shipdate AS DATE)
                      ORDER BY l_orderkey * 10 + l_linenumber DESC, l_extendedprice DESC) AS rn FROM lineitem)
       WHERE rn = 1""",
)
def _(spark, d):
    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    raw = fx.table(spark, d, "lineitem").select(
        F.col("l_partkey").cast("string").alias("property_id"), F.to_date("l_shipdate").alias("snapshot_at"),
        F.floor("l_extendedprice").cast("bigint").alias("rent"), line.alias("line"), "l_extendedprice",
    )
    rows = history.one_per_day(raw, ["line", "l_extendedprice"])
    return rows.select("property_id", _day(), "rent", "line")


@entry("m9_change_log", "SELECT property_id, CAST(snapshot_at AS VARCHAR) AS day, change_type, old_value, new_value, magnitude FROM change_log")
def m9_change_log(spark, d):
    log = history.change_log(history.compared_days(fx.snapshots(spark, d)))
    return log.select(
        "property_id", _day(), "change_type", "old_value", "new_value",
        F.col("change_magnitude").cast("bigint").alias("magnitude"),
    )


@entry(
    "m9_detected_today",
    f"""SELECT CAST(p_partkey AS VARCHAR) AS property_id, '{DAY}' AS day,
               CASE WHEN rent IS NULL THEN 'new_property' ELSE 'rent_changed' END AS change_type,
               CASE WHEN rent IS NULL THEN '' ELSE CAST(rent AS VARCHAR) END AS old_value,
               CASE WHEN rent IS NULL THEN 'New property detected' ELSE CAST(today AS VARCHAR) END AS new_value
        FROM (SELECT p_partkey, CAST(p_size // 10 * 20000 AS BIGINT) AS today, arg_max(rent, snapshot_at) AS rent
              FROM part LEFT JOIN snapshots ON CAST(p_partkey AS VARCHAR) = property_id AND snapshot_at < DATE '{DAY}'
              GROUP BY p_partkey, p_size)
        WHERE rent IS DISTINCT FROM today""",
)
def _(spark, d):
    today = fx.table(spark, d, "part").select(
        F.col("p_partkey").cast("string").alias("id"), (F.floor(F.col("p_size") / 10) * 20000).cast("bigint").alias("rent")
    )
    compared = history.detect_changes(today, fx.snapshots(spark, d), f"{DAY} 09:30:00")
    return history.change_log(compared).select("property_id", _day(), "change_type", "old_value", "new_value")


@entry(
    "m10_flags_and_notes",
    """SELECT property_id, CAST(snapshot_at AS VARCHAR) AS day, n > 0 AS has_changed,
              CASE WHEN n > 0 THEN n || ' changes detected' ELSE '' END AS change_note
       FROM (SELECT s.property_id, s.snapshot_at, count(c.change_type) AS n FROM snapshots s
             LEFT JOIN change_log c ON s.property_id = c.property_id AND s.snapshot_at = c.snapshot_at GROUP BY 1, 2)""",
)
def _(spark, d):
    rows = history.flagged(history.compared_days(fx.snapshots(spark, d)))
    return rows.select("property_id", _day(), "has_changed", "change_note")


@entry(
    "o6_recent_changes",
    """SELECT property_id, change_type FROM change_log ORDER BY snapshot_at DESC, property_id DESC, change_type DESC LIMIT 100""",
)
def _(spark, d):
    log = history.change_log(history.compared_days(fx.snapshots(spark, d)))
    return paging.recent(log, "snapshot_at", 100, "property_id", "change_type").select("property_id", "change_type")
