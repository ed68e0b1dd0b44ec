"""Removal of listings that have been gone for long."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsubo import vocab


def is_expired(as_of, days: int = vocab.RETENTION_DAYS) -> Column:
    limit = F.lit(as_of).cast("timestamp") - F.make_dt_interval(days=F.lit(days))
    return (F.col("status") == vocab.REMOVED) & (F.col("removed_at") < limit)


def expired(listings: DataFrame, as_of, days: int = vocab.RETENTION_DAYS) -> DataFrame:
    return listings.filter(is_expired(as_of, days))


def deletion_log(gone: DataFrame, as_of, reason: str = vocab.DELETE_REASONS[0]) -> DataFrame:
    return gone.select(
        F.col("id").alias("property_id"),
        "title",
        "detail_url",
        "removed_at",
        F.lit(as_of).cast("timestamp").alias("deleted_at"),
        F.lit(reason).alias("reason"),
    )


class Retention(NamedTuple):
    target_count: int
    dry_run: bool
    remaining: DataFrame
    log: DataFrame
    listed: DataFrame


def apply_retention(
    listings: DataFrame,
    as_of,
    days: int = vocab.RETENTION_DAYS,
    cap: int | None = None,
    dry_run: bool = False,
) -> Retention:
    """Split off expired listings. If a cap is given, more of them abort the run.

    The split is a predicate on each row, so nothing is shuffled; only the
    count comes to the driver. A dry run lists the ids and removes nothing.
    """
    gone = expired(listings, as_of, days)
    n = gone.count()
    if cap is not None and n > cap:
        raise ValueError(f"{n} listings would be deleted, {cap} may be")
    stays = listings if dry_run else listings.filter(~F.coalesce(is_expired(as_of, days), F.lit(False)))
    log = deletion_log(gone, as_of)
    return Retention(n, dry_run, stays, log.filter(F.lit(False)) if dry_run else log, gone.select("id"))
