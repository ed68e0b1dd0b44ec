"""Sort modes, pages and cursors."""

from __future__ import annotations

import base64
import binascii
import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsubo import vocab

# --- fixed values: sort modes (column, descending) -------------------------
SORTS = {
    "": ("fetched_at", True),
    "newest": ("fetched_at", True),
    "fetched_at": ("fetched_at", True),
    "fetched_at_desc": ("fetched_at", True),
    "fetched_at_asc": ("fetched_at", False),
    "rent_asc": ("rent", False),
    "rent_desc": ("rent", True),
    "area_desc": ("area", True),
    "area_asc": ("area", False),
    "walk_time_asc": ("walk_time", False),
    "building_age_asc": ("building_age", False),
    "building_age_desc": ("building_age", True),
}
CURSOR_SORTS = {"", "newest", "fetched_at", "fetched_at_desc"}


def sort_columns(sort: str, newest_by: str = "fetched_at", ident: str = "id") -> list[Column]:
    """NULLs last in both directions; the id makes the order total."""
    if sort not in SORTS:
        raise ValueError(f"no such sort mode: {sort}")
    column, descending = SORTS[sort]
    by_time = column == "fetched_at"
    lead = F.col(newest_by if by_time else column)
    tie = F.col(ident).desc() if by_time and descending else F.col(ident).asc()
    return [lead.desc_nulls_last() if descending else lead.asc_nulls_last(), tie]


def ordered(df: DataFrame, sort: str, newest_by: str = "fetched_at") -> DataFrame:
    return df.orderBy(*sort_columns(sort, newest_by))


def checked_limit(limit: int | None) -> int:
    """The page size; none or a non-positive one is the default. Nothing is cut: a large page is as large as asked for."""
    return limit if limit and limit > 0 else vocab.DEFAULT_LIMIT


def top(df: DataFrame, columns: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Order, skip and take. Planned as a bounded top-k, or a sort for deep offsets."""
    frame = df.orderBy(*columns)
    return (frame.offset(offset) if offset else frame).limit(limit)


def after(cursor_time: datetime, cursor_id: str) -> Column:
    """Rows that follow the cursor in newest-first order."""
    t, at = F.col("fetched_at"), F.lit(cursor_time)
    return (t < at) | ((t == at) & (F.col("id") < cursor_id))


def page(
    df: DataFrame, sort: str = "newest", limit: int | None = None, offset: int | None = None, cursor: str = ""
) -> DataFrame:
    """One page. A cursor applies to newest-first only and switches the offset off."""
    if cursor and sort in CURSOR_SORTS:
        df = df.filter(after(*decode_cursor(cursor)))
    skip = 0 if cursor else (offset or 0)
    return top(df, sort_columns(sort), checked_limit(limit), skip)


def encode_cursor(fetched_at: datetime, ident: str) -> str:
    if fetched_at.tzinfo is None:
        fetched_at = fetched_at.replace(tzinfo=timezone.utc)
    text = json.dumps({"t": fetched_at.isoformat().replace("+00:00", "Z"), "id": ident}, separators=(",", ":"))
    return base64.urlsafe_b64encode(text.encode()).decode()


def decode_cursor(cursor: str) -> tuple[datetime, str]:
    try:
        text = base64.b64decode(cursor.encode(), altchars=b"-_", validate=True)
    except (binascii.Error, ValueError):
        raise ValueError("cursor is not base64 text") from None
    try:
        data = json.loads(text)
    except ValueError:
        raise ValueError("cursor holds no JSON") from None
    if not isinstance(data, dict) or not data.get("t") or not data.get("id"):
        raise ValueError("cursor lacks its time or id")
    try:
        at = datetime.fromisoformat(data["t"])
    except (TypeError, ValueError):
        raise ValueError("cursor time cannot be read") from None
    if at.tzinfo is None:
        raise ValueError("cursor time cannot be read")
    return at, data["id"]


def cursor_column(fetched_at: str = "fetched_at", ident: str = "id") -> Column:
    """Cursor text of a row, as encode_cursor writes it for whole seconds."""
    at = F.date_format(fetched_at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    text = F.to_json(F.struct(at.alias("t"), F.col(ident).alias("id")))
    # the last characters, line breaks, have no counterpart and vanish
    return F.translate(F.base64(F.encode(text, "UTF-8")), "+/\r\n", "-_")


def recent(df: DataFrame, at: str, limit: int, *ties: str) -> DataFrame:
    """The latest rows of an activity, change, deletion or history table."""
    return top(df, [F.col(at).desc_nulls_last(), *[F.col(t).desc() for t in ties]], limit)
