"""State of the work queue as set operations."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsubo import vocab
from tsubo.functions import urls
from tsubo.functions.attributes import plus_seconds, retry_delay_seconds

KEY = ["source", "source_property_id"]
OPEN = ["pending", "processing"]


def _moment(as_of) -> Column:
    return F.lit(as_of).cast("timestamp")


def next_items(queue: DataFrame, as_of, k: int = 1) -> DataFrame:
    """What to work on: waiting items first, then failures whose retry is due."""
    waiting = F.col("status") == "pending"
    due = (F.col("status") == "failed") & (F.col("next_retry_at") <= _moment(as_of))
    ready = queue.filter(waiting | due).withColumn("_class", F.when(waiting, 0).otherwise(1))
    order = [F.asc("_class"), F.desc("priority"), F.asc("created_at"), F.asc("id")]
    return ready.orderBy(*order).limit(k).drop("_class")


def free_to_enqueue(listings: DataFrame, queue: DataFrame, as_of) -> DataFrame:
    """Listings neither in work nor finished within the last hours."""
    since = _moment(as_of) - F.make_dt_interval(hours=F.lit(vocab.RECENT_DONE_HOURS))
    fresh = (F.col("status") == "done") & (F.col("updated_at") > since)
    busy = queue.filter(F.col("status").isin(OPEN) | fresh).select(*KEY).distinct()
    return listings.join(busy, KEY, "left_anti")


def _new_items(rows: DataFrame, as_of, priority: int) -> DataFrame:
    return rows.select(
        *KEY,
        "detail_url",
        F.lit("pending").alias("status"),
        F.lit(priority).alias("priority"),
        F.lit(0).alias("attempts"),
        F.lit("").alias("last_error"),
        F.lit(None).cast("timestamp").alias("next_retry_at"),
        _moment(as_of).alias("created_at"),
        _moment(as_of).alias("updated_at"),
        F.lit(None).cast("timestamp").alias("completed_at"),
    )


def reenqueue(listings: DataFrame, queue: DataFrame, as_of, limit: int | None = None) -> DataFrame:
    """New items for active listings; with a limit, for those that were seen longest ago."""
    complete = (F.col("source") != "") & (F.col("source_property_id") != "") & (F.col("detail_url") != "")
    active = listings.filter((F.col("status") == vocab.ACTIVE) & complete)
    free = free_to_enqueue(active, queue, as_of)
    if limit is not None:
        free = free.orderBy(F.asc_nulls_first("last_seen_at"), "id").limit(limit)
    return _new_items(free, as_of, priority=1)


def keyed_urls(found: DataFrame, source: str) -> DataFrame:
    """URLs of a list page with their key; addresses without one are left out."""
    url = F.col("url")
    keyed = found.select(
        F.lit(source).alias("source"), urls.detail_key(url).alias(KEY[1]), urls.existence_form(url).alias("detail_url")
    )
    return keyed.filter(F.col(KEY[1]).isNotNull()).groupBy(*KEY).agg(F.min("detail_url").alias("detail_url"))


def enqueue_unseen(queue: DataFrame, found: DataFrame, listings: DataFrame, as_of, source: str) -> DataFrame:
    """The queue after a list page: unseen URLs join it, failed ones start over.

    Items in work, finished or lost for good stay as they are.
    """
    unseen = keyed_urls(found, source).join(listings.select(*KEY), KEY, "left_anti")
    marks = unseen.select(*KEY, F.lit(True).alias("_listed"))
    reset = F.coalesce(F.col("_listed"), F.lit(False)) & (F.col("status") == "failed")
    at = _moment(as_of)

    def changed(name: str, value: Column) -> Column:
        return F.when(reset, value).otherwise(F.col(name)).alias(name)

    values = {
        "status": F.lit("pending"),
        "attempts": F.lit(0),
        "last_error": F.lit(""),
        "next_retry_at": F.lit(None).cast("timestamp"),
        "updated_at": at,
    }
    kept = queue.join(marks, KEY, "left").select(
        *[changed(c, values[c]) if c in values else F.col(c) for c in queue.columns]
    )
    added = _new_items(unseen.join(queue.select(*KEY).distinct(), KEY, "left_anti"), as_of, priority=0)
    return kept.unionByName(added, allowMissingColumns=True)


# --- fixed values: words that class an error -------------------------------
PERMANENT_WORDS = ["permanent_fail", "404"]
BLOCK_WORDS = ["WAF", "circuit breaker open"]


def _contains_any(text: Column, words: list[str]) -> Column:
    return functools.reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def summary(outcomes: DataFrame, order: tuple[str, ...] = ("at",)) -> DataFrame:
    """One row per item of outcomes(id, at, ok, error): what decides its state, whatever other outcomes there are.

    `firsts` are the places of the first attempts, as many as an item may have; `last`, `closed` and
    `retry` are the last outcome of any kind, one that ended the item, and a retryable error. Only the first
    few rows of an item leave a map task, and the rest is combined there, so a hot item is no single task.
    Summaries of parts of the outcomes give the summary of all, see merged_summaries.
    """
    error = F.coalesce("error", F.lit(""))
    kind = (
        F.when(F.col("ok"), "done")
        .when(_contains_any(error, PERMANENT_WORDS), "permanent_fail")
        .when(_contains_any(error, BLOCK_WORDS), "blocked")
        .otherwise("retry")
    )
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    tries = outcomes.select("id", F.struct(place.alias("place"), "at", kind.alias("kind"), error.alias("error")).alias("_o"))
    first = tries.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy("_o"))).filter(F.col("_n") <= vocab.MAX_ATTEMPTS)
    firsts = first.groupBy("id").agg(F.sort_array(F.collect_list("_o.place")).alias("firsts"))

    def last(*kinds: str) -> Column:
        return F.max(F.when(F.col("_o.kind").isin(list(kinds)), F.col("_o")) if kinds else F.col("_o"))

    rest = tries.groupBy("id").agg(
        F.count("*").alias("tries"), last().alias("last"), last("done", "permanent_fail").alias("closed"), last("retry").alias("retry")
    )
    # a missing id belongs to no item
    return rest.join(firsts, "id").select("id", "tries", "firsts", "last", "closed", "retry")


def merged_summaries(summaries: DataFrame) -> DataFrame:
    """One summary per item; there are as many rows of an item as parts."""
    firsts = F.sort_array(F.flatten(F.collect_list("firsts")))
    return summaries.groupBy("id").agg(
        F.sum("tries").alias("tries"), F.slice(firsts, 1, vocab.MAX_ATTEMPTS).alias("firsts"),
        F.max("last").alias("last"), F.max("closed").alias("closed"), F.max("retry").alias("retry"),
    )


def apply_outcomes(queue: DataFrame, outcomes: DataFrame, order: tuple[str, ...] = ("at",)) -> DataFrame:
    """State of the queue after outcomes(id, at, ok, error); an item may have many.

    Every outcome is one more attempt. The last one decides the state; the last
    one that ended the item decides completed_at. Outcomes are reduced to one
    row per item, with a map-side combine, before they meet the queue.
    """
    return apply_summaries(queue, summary(outcomes, order))


def apply_summaries(queue: DataFrame, summaries: DataFrame) -> DataFrame:
    """State of the queue after the outcomes that the summaries (one per item) stand for."""
    joined = queue.join(summaries.withColumnsRenamed({c: f"_{c}" for c in ("tries", "firsts", "last", "closed", "retry")}), "id", "left")

    # an item is spent by a retryable error from the fifth attempt on; the last
    # such error is the latest of them, so it alone decides
    before = F.col("attempts")
    nth = F.size(F.filter("_firsts", lambda f: f <= F.col("_retry.place")))  # exact below the limit
    retry_spent = before + nth >= vocab.MAX_ATTEMPTS
    later = F.coalesce(F.col("_retry") > F.col("_closed"), F.col("_closed").isNull())
    ended = F.when(retry_spent & later, F.col("_retry.at")).otherwise(F.col("_closed.at"))
    n = (before + F.col("_tries")).cast("int")
    at, error, tried = F.col("_last.at"), F.col("_last.error"), F.col("_last").isNotNull()
    kind = F.when((F.col("_last.kind") == "retry") & (n >= vocab.MAX_ATTEMPTS), "spent").otherwise(F.col("_last.kind"))
    values = {
        "status": F.when(kind.isin("done", "permanent_fail"), kind).otherwise("failed"),
        "attempts": n,
        "last_error": F.when(kind == "done", "")
        .when(kind == "permanent_fail", F.concat(F.lit("404 Not Found (permanent): "), error))
        .when(kind == "blocked", F.concat(F.lit("WAF/circuit breaker: "), error))
        .when(kind == "spent", F.format_string("Max retries exceeded (%d): %s", n, error))
        .otherwise(error),
        "next_retry_at": F.when(kind == "blocked", plus_seconds(at, vocab.BLOCK_COOLDOWN_SECONDS)).when(
            kind == "retry", plus_seconds(at, retry_delay_seconds(n - 1))
        ),
        "completed_at": F.coalesce(ended, F.col("completed_at")),
        "updated_at": at,
    }
    return joined.select(
        *[F.when(tried, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in queue.columns]
    )
