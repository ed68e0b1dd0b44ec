"""Existence tests between listings, stations, URLs and the queue."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CASE_FREE = "UNICODE_CI_AI"


def text_contains(column: str, text: str, case_free: bool = False) -> Column:
    """Literal containment; case_free also ignores accents."""
    if case_free:
        return F.contains(F.collate(F.col(column), CASE_FREE), F.collate(F.lit(text), CASE_FREE))
    return F.col(column).contains(text)


def having_stations(listings: DataFrame, stations: DataFrame, *conditions: Column) -> DataFrame:
    """Listings with, for each condition, some station that meets it.

    Different stations may meet different conditions. All conditions are tested
    in one scan and one aggregation of the stations; its map-side combine
    reduces a listing with very many stations, and the join reuses its
    partitioning.
    """
    if not conditions:
        return listings
    flags = [f"_met_{i}" for i in range(len(conditions))]
    met = (
        stations.select(F.col("property_id").alias("id"), *[c.alias(f) for c, f in zip(conditions, flags)])
        .filter(functools.reduce(lambda a, b: a | b, [F.col(f) for f in flags]))
        .groupBy("id")
        .agg(*[F.bool_or(f).alias(f) for f in flags])
        .filter(functools.reduce(lambda a, b: a & b, [F.col(f) for f in flags]))
    )
    return listings.join(met, "id", "left_semi")


def station_named(listings: DataFrame, stations: DataFrame, text: str, case_free: bool = False) -> DataFrame:
    return having_stations(listings, stations, text_contains("station_name", text, case_free))


def line_named(listings: DataFrame, stations: DataFrame, text: str, case_free: bool = False) -> DataFrame:
    return having_stations(listings, stations, text_contains("line_name", text, case_free))


def walk_within(minutes: int) -> Column:
    """0 minutes (bus access) qualifies too; NULL does not."""
    return F.col("walk_minutes") <= minutes


def any_station_within(listings: DataFrame, stations: DataFrame, minutes: int) -> DataFrame:
    return having_stations(listings, stations, walk_within(minutes))


def known_and_unseen(urls: DataFrame, listings: DataFrame, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """Split rows by whether a listing with the same key, unique there, exists."""
    known = listings.select(*key)
    return urls.join(known, key, "left_semi"), urls.join(known, key, "left_anti")


def stored_match(incoming: DataFrame, current: DataFrame, key: list[str]) -> DataFrame:
    """Incoming rows with the id and creation time of the stored row of the same key."""
    stored = current.select(*key, F.col("id").alias("stored_id"), F.col("created_at").alias("stored_created_at"))
    return incoming.join(stored, key, "left")


def first_positions(rows: DataFrame, key: Column, position: str, name: str = "url") -> DataFrame:
    """Each distinct key with the first position it stands at."""
    return rows.groupBy(key.alias(name)).agg(F.min(position).alias("first_position"))


def id_sets(left: DataFrame, right: DataFrame, key: str = "id") -> DataFrame:
    """Each id once, with the side it is on: left, right or both."""
    a = left.select(key).distinct().withColumn("_l", F.lit(True))
    b = right.select(key).distinct().withColumn("_r", F.lit(True))
    side = F.when(F.col("_r").isNull(), "left").when(F.col("_l").isNull(), "right").otherwise("both")
    return a.join(b, key, "full_outer").select(key, side.alias("side"))


def previous_snapshot(listings: DataFrame, snapshots: DataFrame, as_of) -> DataFrame:
    """Each listing with its latest snapshot before the day of as_of, if any.

    The latest snapshot per listing is an aggregate with a map-side combine,
    not a window.
    """
    day = F.to_date(F.lit(as_of).cast("timestamp"))
    columns = [c for c in snapshots.columns if c != "property_id"]
    last = (
        snapshots.filter(F.col("snapshot_at") < day)
        .groupBy(F.col("property_id").alias("id"))
        .agg(F.max_by(F.struct(*columns), "snapshot_at").alias("previous"))
    )
    return listings.join(last, "id", "left")
