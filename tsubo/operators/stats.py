"""Counts, histograms, quality and health reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsubo import vocab
from tsubo.session import fixed_rows


def _moment(as_of) -> Column:
    return F.lit(as_of).cast("timestamp")


def metrics(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One pass over df, one (metric, value) row per aggregate."""
    row = df.agg(*[v.cast("bigint").alias(n) for n, v in values.items()])
    return row.unpivot([], list(values), "metric", "value")


def zero_filled(spark: SparkSession, counts: DataFrame, column: str, words: list[str]) -> DataFrame:
    """One row per word of a fixed list, 0 where it does not occur. The counts
    have at most one row per word, hence the broadcast."""
    every = fixed_rows(spark, [(w,) for w in words], f"{column} string")
    return every.join(F.broadcast(counts.filter(F.col(column).isin(words))), column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def total(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("total"))


def listing_counts(listings: DataFrame) -> DataFrame:
    """Active, removed and their sum; other statuses are not counted."""
    active = F.count_if(F.col("status") == vocab.ACTIVE)
    removed = F.count_if(F.col("status") == vocab.REMOVED)
    return listings.agg(active.alias("active"), removed.alias("removed"), (active + removed).alias("total"))


def recent_counts(listings: DataFrame, changes: DataFrame, as_of, hours: int = 24, days: int = 7) -> DataFrame:
    at = _moment(as_of)
    fetched = F.count_if(F.col("fetched_at") >= at - F.make_dt_interval(hours=F.lit(hours)))
    changed = F.count_if(F.col("detected_at") >= at - F.make_dt_interval(days=F.lit(days)))
    return metrics(listings, {"fetched_last_24h": fetched}).unionByName(
        metrics(changes, {"changes_last_7_days": changed})
    )


def top_stations(listings: DataFrame, limit: int = 20) -> DataFrame:
    named = listings.filter((F.col("status") == vocab.ACTIVE) & (F.col("station") != ""))
    counts = named.groupBy("station").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "station").limit(limit)


def rent_histogram(listings: DataFrame) -> DataFrame:
    """Six half-open bins in one pass; empty bins show 0."""
    spark = listings.sparkSession
    bins = fixed_rows(spark, vocab.RENT_BINS, "range_label string, min_rent int, max_rent int")
    low = F.lit(None).cast("int")
    for _, start, end in reversed(vocab.RENT_BINS):
        low = F.when((F.col("rent") >= start) & (F.col("rent") < end), F.lit(start)).otherwise(low)
    counts = (
        listings.filter(F.col("status") == vocab.ACTIVE)
        .filter(F.col("rent").between(vocab.RENT_BINS[0][1], vocab.RENT_BINS[-1][2] - 1))
        .groupBy(low.alias("min_rent"))
        .agg(F.count("*").alias("n"))
    )
    # one row per bin at most on either side
    joined = bins.join(F.broadcast(counts), "min_rent", "left")
    return joined.select("range_label", "min_rent", "max_rent", F.coalesce("n", F.lit(0)).alias("n"))


def queue_counts(queue: DataFrame) -> DataFrame:
    counts = queue.groupBy("status").agg(F.count("*").alias("n"))
    return zero_filled(queue.sparkSession, counts, "status", vocab.QUEUE_STATUSES)


def deletion_stats(delete_logs: DataFrame, listings: DataFrame, as_of, days: int = vocab.RETENTION_DAYS) -> DataFrame:
    """Totals, one row per reason, and what retention would take next."""
    at = _moment(as_of)
    removed = F.col("status") == vocab.REMOVED
    due = removed & (F.col("removed_at") < at - F.make_dt_interval(days=F.lit(days)))
    logged = metrics(
        delete_logs,
        {
            "total_deleted": F.count("*"),
            "deleted_last_30_days": F.count_if(F.col("deleted_at") >= at - F.make_dt_interval(days=F.lit(30))),
            **{f"reason_{r}": F.count_if(F.col("reason") == r) for r in vocab.DELETE_REASONS},
        },
    )
    pending = metrics(
        listings, {"currently_removed": F.count_if(removed), "expired_ready_for_deletion": F.count_if(due)}
    )
    return logged.unionByName(pending)


def id_quality(listings: DataFrame) -> DataFrame:
    """How many ids came from the page address, how many are hash fallbacks."""
    size = F.length("source_property_id")
    fallback = size == 32
    return listings.agg(
        F.count("*").alias("total"),
        F.count_if(size.between(40, 48)).alias("extracted"),
        F.count_if(fallback).alias("fallback"),
        F.count_if(size.isNull()).alias("missing"),
        F.min(F.when(fallback, F.col("created_at"))).alias("oldest_fallback"),
        F.max(F.when(fallback, F.col("created_at"))).alias("newest_fallback"),
    )


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


# --- fixed values: what counts as a block or a success in log lines --------
LOG_MARKS = {
    "success": "(?i)successfully scraped",
    "breaker_open": "(?i)circuit breaker open",
    "waf": "(?i)waf",
    "status_403": " 403 |status.?403",
    "status_429": " 429 |status.?429",
    "status_500": " 500 |status.?500",
}


def log_health(lines: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Counts over log lines (ts, line) of the last hours, and pass when nothing blocked."""
    at = _moment(as_of)
    fresh = lines.filter((F.col("ts") > at - F.make_dt_interval(hours=F.lit(hours))) & (F.col("ts") <= at))
    counted = fresh.agg(*[F.count_if(F.col("line").rlike(p)).alias(n) for n, p in LOG_MARKS.items()])
    blocks = F.col("breaker_open") + F.col("waf") + F.col("status_403") + F.col("status_429")
    return counted.withColumn("blocks", blocks).withColumn("passed", F.col("blocks") == 0)


def page_quality(listings: DataFrame) -> DataFrame:
    """Shares of rows without title and without station, and whether both are low enough."""
    n = F.count("*")
    no_title = F.count_if(F.col("title") == vocab.NO_TITLE)
    no_station = F.count_if(F.coalesce(F.col("station"), F.lit("")) == "")
    counted = listings.agg(n.alias("total"), no_title.alias("no_title"), no_station.alias("no_station"))
    title_ratio = F.try_divide("no_title", "total")
    station_ratio = F.try_divide("no_station", "total")
    return counted.select(
        "*",
        F.round(100 * title_ratio, 1).alias("no_title_pct"),
        F.round(100 * station_ratio, 1).alias("no_station_pct"),
        ((title_ratio < vocab.MAX_NO_TITLE_RATIO) & (station_ratio < vocab.MAX_NO_STATION_RATIO)).alias("passed"),
    )


def graded(value: Column, levels: tuple) -> Column:
    warn, danger = levels
    return F.when(value >= danger, "danger").when(value >= warn, "warn").otherwise("ok")


def queue_kpis(queue: DataFrame, as_of) -> DataFrame:
    """Backlog size, age of the oldest waiting item and share of lost items, graded."""
    waiting = F.col("status") == "pending"
    counted = queue.agg(
        F.count_if(waiting).alias("pending"),
        F.min(F.when(waiting, F.col("created_at"))).alias("_oldest"),
        F.try_divide(F.count_if(F.col("status") == "permanent_fail"), F.count("*")).alias("_lost"),
    )
    hours = F.timestamp_diff("HOUR", F.col("_oldest"), _moment(as_of))
    age, lost = F.coalesce(hours, F.lit(0)), F.coalesce(F.col("_lost"), F.lit(0.0))
    return counted.select(
        "pending",
        graded(F.col("pending"), vocab.PENDING_LEVELS).alias("pending_grade"),
        age.alias("oldest_hours"),
        graded(age, vocab.OLDEST_PENDING_HOURS).alias("oldest_grade"),
        F.round(lost, 4).alias("permanent_fail_rate"),
        graded(lost, vocab.PERMANENT_FAIL_RATE).alias("permanent_fail_grade"),
    )


def marked_count(listings: DataFrame, marks: DataFrame, mark: str = "candidate") -> DataFrame:
    """Marks of the word, and how many of them are on listings that still exist."""
    wanted = marks.filter(F.col("mark") == mark).select(F.col("property_id").alias("id")).distinct()
    held = listings.select("id", F.lit(True).alias("_held"))
    return wanted.join(held, "id", "left").agg(
        F.count("*").alias("marked"), F.count("_held").alias("marked_listings")
    )
