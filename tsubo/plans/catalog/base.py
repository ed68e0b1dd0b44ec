"""Registration, the SQL twins of the fixture views, and output forms."""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsubo import vocab
from tsubo.sources import fixtures as fx


class Entry(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


CATALOG: dict[str, Entry] = {}


def entry(name: str, sql: str | None = None):
    """Register a query; sql may name the views below and gets them as CTEs."""
    def register(run: Callable[[SparkSession, str], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"query {name} registered twice")
        CATALOG[name] = Entry(run, with_views(sql) if sql else None)
        return run

    return register


# ------------------------------------------------------------- output forms
def stamp(column: str | Column) -> Column:
    """Timestamps as text, the same in both engines."""
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def stamp_sql(column: str) -> str:
    return f"strftime({column}, '%Y-%m-%d %H:%M:%S')"


def text_list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def values_rows(table: dict[str, str]) -> str:
    rows = ", ".join(f"('{k}', '{v}')" for k, v in table.items())
    return f"(VALUES {rows})"


def pick_sql(values: list[str], number: str) -> str:
    return f"list_extract({text_list(values)}, CAST({number} AS BIGINT) % {len(values)} + 1)"


# ---------------------------------------------------------------- SQL views
_FACILITIES = ", ".join(f"CASE WHEN o_orderkey % {i + 2} = 0 THEN '{n}' END" for i, n in enumerate(fx.FACILITIES))

VIEWS = {
    "listings": f"""
        SELECT o_orderkey AS order_key, md5('demo:' || o_orderkey) AS id, 'demo' AS source,
               CAST(o_orderkey AS VARCHAR) AS source_property_id,
               'https://listings.example/rent/detail/' || lpad(CAST(o_orderkey AS VARCHAR), 40, '0') AS detail_url,
               'https://img.example/' || o_orderkey || '.jpg' AS image_url,
               concat_ws(' - ', c_name, c_mktsegment) AS title,
               CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE n_name END AS station,
               concat_ws(' ', n_name, c_mktsegment) AS address,
               CASE WHEN o_orderkey % 17 <> 0 THEN CAST(floor(o_totalprice) AS INTEGER) END AS rent,
               CASE WHEN o_orderkey % 23 <> 0 THEN CAST((o_orderkey % 800 + 50) / 10.0 AS DECIMAL(10,2)) END AS area,
               {pick_sql(fx.PLANS, 'o_orderkey')} AS floor_plan,
               {pick_sql(fx.TYPES, 'o_orderkey')} AS building_type,
               CAST(o_orderkey % 50 AS INTEGER) AS building_age,
               CAST(o_orderkey % 30 + 1 AS INTEGER) AS floor,
               [f FOR f IN [{_FACILITIES}] IF f IS NOT NULL] AS facilities,
               w.walk_time,
               CASE WHEN o_orderstatus = 'F' THEN 'removed' ELSE 'active' END AS status,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL 30 DAY END AS removed_at,
               CASE WHEN o_orderkey % 13 <> 0 THEN o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)) END
                   AS last_seen_at,
               o_orderdate AS fetched_at, o_orderdate AS created_at, o_orderdate AS updated_at
        FROM orders
        LEFT JOIN customer ON o_custkey = c_custkey
        LEFT JOIN nation ON c_nationkey = n_nationkey
        LEFT JOIN (SELECT l_orderkey, CAST(min(l_quantity) AS INTEGER) AS walk_time FROM lineitem GROUP BY 1) w
               ON o_orderkey = w.l_orderkey""",
    "stations": """
        SELECT md5('demo:' || l_orderkey) AS property_id, CAST(l_quantity AS INTEGER) AS walk_minutes,
               n_name AS station_name, s_name AS line_name, l_orderkey AS order_key,
               row_number() OVER (PARTITION BY l_orderkey
                   ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS sort_order
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "images": """
        SELECT md5('demo:' || l_orderkey) AS property_id,
               'https://img.example/' || l_partkey || '-' || l_suppkey || '.jpg' AS image_url,
               row_number() OVER (PARTITION BY l_orderkey
                   ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS sort_order
        FROM lineitem""",
    "snapshots": """
        SELECT CAST(l_partkey AS VARCHAR) AS property_id, CAST(l_shipdate AS DATE) AS snapshot_at,
               CAST(floor(max(l_extendedprice) / 20000) * 20000 AS BIGINT) AS rent,
               CAST(max(l_quantity) AS DECIMAL(10,2)) AS area, min(l_returnflag) AS floor_plan,
               min(l_linestatus) AS status
        FROM lineitem GROUP BY 1, 2""",
    "compared": """
        SELECT *, lag(snapshot_at) OVER w AS p_day, lag(rent) OVER w AS p_rent, lag(area) OVER w AS p_area,
               lag(floor_plan) OVER w AS p_plan, lag(status) OVER w AS p_status
        FROM snapshots WINDOW w AS (PARTITION BY property_id ORDER BY snapshot_at)""",
    "change_log": f"""
        SELECT property_id, snapshot_at, 'new_property' AS change_type, '' AS old_value,
               '{vocab.NEW_LISTING_NOTE}' AS new_value, CAST(NULL AS BIGINT) AS magnitude
        FROM compared WHERE p_day IS NULL
        UNION ALL SELECT property_id, snapshot_at, 'rent_changed', CAST(p_rent AS VARCHAR), CAST(rent AS VARCHAR),
               rent - p_rent FROM compared WHERE p_day IS NOT NULL AND rent <> p_rent
        UNION ALL SELECT property_id, snapshot_at, 'status_changed', p_status, status, NULL
        FROM compared WHERE p_day IS NOT NULL AND status <> p_status
        UNION ALL SELECT property_id, snapshot_at, 'floor_plan_changed', p_plan, floor_plan, NULL
        FROM compared WHERE p_day IS NOT NULL AND floor_plan <> p_plan
        UNION ALL SELECT property_id, snapshot_at, 'area_changed', CAST(p_area AS VARCHAR), CAST(area AS VARCHAR), NULL
        FROM compared WHERE p_day IS NOT NULL AND area <> p_area""",
    "crawl": """
        SELECT * REPLACE ('active' AS status, CAST(NULL AS TIMESTAMP) AS removed_at,
               CASE WHEN order_key % 7 = 0 THEN rent + 1000 ELSE rent END AS rent)
        FROM listings WHERE order_key % 11 <> 0
        UNION ALL
        SELECT * REPLACE ('active' AS status, CAST(NULL AS TIMESTAMP) AS removed_at,
               'n' || order_key AS source_property_id, md5('demo:n' || order_key) AS id,
               detail_url || 'n' AS detail_url)
        FROM listings WHERE order_key % 13 = 0""",
    "marks": """
        SELECT property_id, mark FROM (
            SELECT md5('demo:' || o_orderkey) AS property_id,
                   CASE WHEN o_orderkey % 5 = 0 THEN 'candidate' WHEN o_orderkey % 5 = 1 THEN 'maybe'
                        WHEN o_orderkey % 10 = 2 THEN 'excluded' END AS mark
            FROM orders) WHERE mark IS NOT NULL""",
    "requests": """
        SELECT user_id AS key, ts, event_id AS id, event_type = 'error' AS failed,
               CASE WHEN event_type = 'error' THEN list_extract([500, 429, 403, 404], event_id % 4 + 1)
                    ELSE 200 END AS status_code
        FROM events""",
    "queue": """
        SELECT user_id AS id, 'demo' AS source, CAST(user_id AS VARCHAR) AS source_property_id,
               'https://listings.example/rent/detail/' || lpad(CAST(user_id AS VARCHAR), 40, '0') AS detail_url,
               status, CAST(user_id % 3 AS INTEGER) AS priority, attempts,
               CASE WHEN status = 'failed' THEN 'timeout' ELSE '' END AS last_error,
               CASE WHEN status = 'failed' AND attempts < 100 THEN updated_at + to_seconds(
                   list_extract([300, 900, 3600, 14400, 43200], least(attempts, 5))) END AS next_retry_at,
               created_at, updated_at,
               CASE WHEN status IN ('done', 'permanent_fail') THEN updated_at END AS completed_at
        FROM (SELECT user_id, CAST(count(*) FILTER (event_type = 'error') AS INTEGER) AS attempts,
                     min(ts) AS created_at, max(ts) AS updated_at,
                     CASE arg_max(event_type, {'t': ts, 'i': event_id})
                          WHEN 'view' THEN 'pending' WHEN 'click' THEN 'processing' WHEN 'signup' THEN 'done'
                          WHEN 'purchase' THEN 'permanent_fail' ELSE 'failed' END AS status
              FROM events GROUP BY user_id)""",
    "delete_logs": f"""
        SELECT id AS property_id, detail_url, removed_at, removed_at + INTERVAL 90 DAY AS deleted_at,
               {pick_sql(vocab.DELETE_REASONS, 'order_key')} AS reason
        FROM listings WHERE status = 'removed'""",
    "raw_attributes": f"""
        SELECT o_orderkey AS order_key, 'メゾン' || o_orderkey AS name,
               {pick_sql(fx.ROOM_LAYOUTS, 'o_orderkey')} AS raw_layout,
               {pick_sql(fx.KINDS, 'o_orderkey')} AS raw_kind,
               {pick_sql(fx.STRUCTURES, 'o_orderkey // 2')} AS raw_structure,
               [{pick_sql(fx.CODES, 'o_orderkey')}, {pick_sql(fx.CODES, 'o_orderkey // 3')},
                {pick_sql(fx.CODES, 'o_orderkey // 5')}] AS codes,
               [{pick_sql(list(vocab.FACILITY_LABELS), 'o_orderkey')},
                '対応 ' || {pick_sql(list(vocab.FACILITY_LABELS), 'o_orderkey * 3 + 1')}, 'その他設備'] AS raw_labels,
               CAST((o_orderkey * 37) % 1200 * 1000 + 500 AS INTEGER) AS yen,
               CAST(o_orderkey % 620 AS INTEGER) AS square_metres, CAST(o_orderkey % 70 AS INTEGER) AS minutes,
               CAST(o_orderkey % 110 AS INTEGER) AS years, CAST(o_orderkey % 13 AS INTEGER) AS storey
        FROM orders""",
}


def with_views(sql: str) -> str:
    """Prepend the views a statement names, in the order they depend on each other."""
    chosen: list[str] = []

    def add(text: str) -> None:
        for name in VIEWS:
            if name not in chosen and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                add(VIEWS[name])
                chosen.append(name)

    add(sql)
    if not chosen:
        return sql
    ctes = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in chosen)
    own = re.match(r"\s*WITH\s", sql)
    return f"WITH {ctes},\n{sql[own.end():]}" if own else f"WITH {ctes}\n{sql}"
