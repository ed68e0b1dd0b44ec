"""Predicates of the listing search."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsubo import vocab
from tsubo.functions.attributes import has_all

YEN = 1
TEN_THOUSAND_YEN = 10000


def between(column: str, low=None, high=None, unit: int = 1) -> Column | None:
    """Closed range with open ends; rows with NULL drop out. None when no bound is set."""
    parts = []
    if low is not None:
        parts.append(F.col(column) >= F.lit(low * unit))
    if high is not None:
        parts.append(F.col(column) <= F.lit(high * unit))
    return functools.reduce(lambda a, b: a & b, parts) if parts else None


def one_of(column: str, values: list[str]) -> Column | None:
    return F.col(column).isin(list(values)) if values else None


def has_facilities(keys: list[str], column: str = "facilities") -> Column | None:
    """All keys must be present; a key outside the vocabulary is an error."""
    if not keys:
        return None
    known = set(vocab.FACILITY_CODES.values()) | set(vocab.FACILITY_LABELS.values())
    unknown = sorted(set(keys) - known)
    if unknown:
        raise ValueError(f"unknown amenity keys: {unknown}")
    return has_all(F.col(column), keys)


def nearest_walk(minutes: int | None) -> Column | None:
    """Walk time of the nearest station; NULL does not qualify."""
    return F.col("walk_time") <= minutes if minutes else None


def all_of(*conditions: Column | None) -> Column:
    present = [c for c in conditions if c is not None]
    return functools.reduce(lambda a, b: a & b, present) if present else F.lit(True)


def keep(df: DataFrame, *conditions: Column | None) -> DataFrame:
    present = [c for c in conditions if c is not None]
    return df.filter(all_of(*present)) if present else df


def yen_conditions(
    min_rent=None, max_rent=None, min_area=None, max_area=None, max_walk=None, floor_plans=()
) -> Column:
    """The predicate set of the keyword search; money is in plain yen."""
    return all_of(
        between("rent", min_rent, max_rent),
        between("area", min_area, max_area),
        between("walk_time", None, max_walk),
        one_of("floor_plan", list(floor_plans)),
    )


def without_ids(listings: DataFrame, ids: list[str] | DataFrame) -> DataFrame:
    """Drop listed ids. A frame of ids may have any length and is anti joined."""
    if isinstance(ids, DataFrame):
        return listings.join(ids.select("id").distinct(), "id", "left_anti")
    return listings.filter(~F.col("id").isin(list(ids))) if ids else listings


def with_mark(listings: DataFrame, marks: DataFrame, wanted: list[str]) -> DataFrame:
    """Attach the user's mark ('none' when unmarked) and keep the wanted ones."""
    marked = listings.join(marks.withColumnRenamed("property_id", "id"), "id", "left")
    marked = marked.withColumn("mark", F.coalesce("mark", F.lit("none")))
    return marked.filter(F.col("mark").isin(wanted)) if wanted else marked
