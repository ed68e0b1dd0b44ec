"""Windows over a request log: requests(key, ts, id, failed, status_code)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsubo import vocab
from tsubo.functions.attributes import plus_seconds
from tsubo.operators.keyed import chunked, running

# --- fixed values: trailing windows in seconds -----------------------------
WINDOWS = {"minute": 60, "hour": 3600, "day": 86400}
ROWS_PER_BLOCK = 100_000


def trailing_counts(
    requests: DataFrame, limits: dict[str, int], windows: dict[str, int] | None = None, chunk: str = "hour"
) -> DataFrame:
    """Requests of the key in each trailing window, and what its limit leaves.

    A request enters every window at its time and leaves a window exactly its
    length later, so a trailing count is a running sum of arrivals minus
    departures. That costs one pass per (key, chunk) instead of a frame scan
    per request, and a busy key is split over its chunks.
    """
    windows = windows or WINDOWS

    def step(at: Column, ident: Column, moves: dict[str, int]) -> Column:
        deltas = [F.lit(moves.get(w, 0)).cast("bigint").alias(f"_d_{w}") for w in windows]
        return F.struct(at.alias("_at"), ident.alias("id"), *deltas)

    nobody = F.lit(None).cast(requests.schema["id"].dataType)
    arrival = step(F.col("ts"), F.col("id"), dict.fromkeys(windows, 1))
    leaving = [step(plus_seconds(F.col("ts"), s), nobody, {w: -1}) for w, s in windows.items()]
    moves = requests.select("key", F.inline(F.array(arrival, *leaving)))
    counted = running(
        moves,
        ["key"],
        ["_at"],
        F.date_trunc(chunk, "_at"),
        sums={f"last_{w}": F.col(f"_d_{w}") for w in windows},
        peers=True,
        at="_at",
    )
    used = counted.filter(F.col("id").isNotNull())
    return used.select(
        "key",
        F.col("_at").alias("ts"),
        "id",
        *[f"last_{w}" for w in windows],
        *[
            F.greatest(F.lit(limits[w]) - F.col(f"last_{w}"), F.lit(0)).alias(f"remaining_{w}")
            for w in windows
            if w in limits
        ],
    )


def usage_at(requests: DataFrame, as_of, limits: dict[str, int], windows: dict[str, int] | None = None) -> DataFrame:
    """Usage of every key at one moment: used, remaining and percent of the limit."""
    windows = windows or WINDOWS
    at = F.lit(as_of).cast("timestamp")
    past = requests.filter(F.col("ts") <= at)
    used = past.groupBy("key").agg(
        *[F.count_if(F.col("ts") > plus_seconds(at, -s)).alias(f"last_{w}") for w, s in windows.items()]
    )
    for w in windows:
        if w in limits:
            n, limit = F.col(f"last_{w}"), F.lit(limits[w])
            used = used.withColumn(f"remaining_{w}", F.greatest(limit - n, F.lit(0)))
            used = used.withColumn(f"percent_{w}", F.least(F.round(100 * n / limit, 2), F.lit(100.0)))
    return used


def progress(requests: DataFrame, chunk: str = "hour") -> DataFrame:
    """Each request with its number, the failures so far, the failure streak it
    is in, and whether it flags a block.

    A streak is the distance in requests to the last success. Numbers are local
    to a (key, chunk) first and then shifted by what earlier chunks hold. A block is a streak
    of two or more that ends in a blocking code, or a failure while at least 40 %
    of 20 or more requests have failed.
    """
    part = ["key", "_chunk"]
    failed = F.col("failed")
    inside = W.partitionBy(*part).orderBy("ts", "id").rowsBetween(W.unboundedPreceding, W.currentRow)
    local = (
        chunked(requests, ["key"], F.date_trunc(chunk, "ts"), "ts")
        .withColumn("_n", F.count("*").over(inside))
        .withColumn("_f", F.count_if(failed).over(inside))
        .withColumn("_s", F.max(F.when(~failed, F.col("_n"))).over(inside))
    )
    earlier = W.partitionBy("key").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = (
        local.groupBy(*part)
        .agg(F.max("_n").alias("_n"), F.max("_f").alias("_f"), F.max("_s").alias("_s"))
        .withColumn("_n0", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .withColumn("_f0", F.coalesce(F.sum("_f").over(earlier), F.lit(0)))
        .withColumn("_s0", F.coalesce(F.max(F.col("_n0") + F.col("_s")).over(earlier), F.lit(0)))
        .select(*part, "_n0", "_f0", "_s0")
    )
    counted = local.join(carried, part).select(
        *requests.columns,
        (F.col("_n0") + F.col("_n")).alias("n"),
        (F.col("_f0") + F.col("_f")).alias("failures"),
        F.greatest(F.col("_s0"), F.col("_n0") + F.col("_s")).alias("_last_success"),
    )
    streak = F.col("n") - F.col("_last_success")
    rate = F.col("failures") / F.col("n")
    by_streak = (
        failed & (streak >= vocab.STREAK_BLOCK_LENGTH) & F.col("status_code").isin(vocab.STREAK_BLOCK_CODES)
    )
    by_rate = failed & (F.col("n") >= vocab.RATE_BLOCK_MIN_REQUESTS) & (rate >= vocab.RATE_BLOCK_THRESHOLD)
    return counted.select(
        *requests.columns,
        "n",
        "failures",
        streak.alias("streak"),
        rate.alias("failure_rate"),
        by_streak.alias("streak_block"),
        by_rate.alias("rate_block"),
    )


def recent_failure_rate(requests: DataFrame, last: int = vocab.FAILURE_WINDOW, chunk: str = "hour") -> DataFrame:
    """Share of failures among the last requests of the key, this one included.

    Requests are numbered per key and cut into blocks of numbers; the tail of a
    block is repeated at the head of the next one. So a window task holds one
    block, and every row still sees all its predecessors.
    """
    size = max(ROWS_PER_BLOCK, last)
    numbered = running(
        requests, ["key"], ["ts", "id"], F.date_trunc(chunk, "ts"), sums={"n": F.lit(1).cast("bigint")}, at="ts"
    )
    block = F.floor((F.col("n") - 1) / size)
    tail = (F.col("n") - 1) % size >= size - (last - 1)
    spread = numbered.withColumn("_block", F.explode(F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))))
    window = W.partitionBy("key", "_block").orderBy("n").rowsBetween(1 - last, W.currentRow)
    rated = spread.withColumn("recent_rate", F.avg(F.col("failed").cast("double")).over(window))
    return rated.filter(F.col("_block") == block).drop("_block")


def hour_band(
    ts: Column,
    night: tuple[int, int, int],
    day: tuple[int, int, int],
    default: int,
) -> Column:
    """Allowance by hour of day; a band is (from, to, allowance) and may wrap midnight."""
    hour = F.hour(ts)

    def inside(start: int, end: int) -> Column:
        start, end = start % 24, end % 24
        if start < end:
            return (hour >= start) & (hour < end)
        return (hour >= start) | (hour < end)

    def clamped(n: int) -> Column:
        return F.lit(min(max(n, 1), 60))

    return (
        F.when(inside(*night[:2]), clamped(night[2]))
        .when(inside(*day[:2]), clamped(day[2]))
        .otherwise(clamped(default))
    )


def block_state(
    requests: DataFrame, as_of, cooling_seconds: int = vocab.BLOCK_COOLDOWN_SECONDS, chunk: str = "hour"
) -> DataFrame:
    """State of every key after its log: counters, last times, block and can_run.

    A success clears the block and the failure counter, so only what follows the
    last success counts, and all of that has failed. With the requests of a key
    numbered, everything is one aggregate with a map-side combine.
    """
    ordered = running(
        requests, ["key"], ["ts", "id"], F.date_trunc(chunk, "ts"), sums={"n": F.lit(1).cast("bigint")}, at="ts"
    )
    failed = F.col("failed")
    blocking = failed & F.col("status_code").isin(vocab.STREAK_BLOCK_CODES)
    state = ordered.groupBy("key").agg(
        F.max("n").alias("_n"),
        F.coalesce(F.max(F.when(~failed, F.col("n"))), F.lit(0)).alias("_last_success"),
        F.count_if(~failed).alias("success_count"),
        F.max("ts").alias("last_attempt"),
        F.max(F.when(~failed, F.col("ts"))).alias("last_success"),
        F.max(F.when(blocking, F.struct("n", "ts", "status_code"))).alias("_blocking"),
    )
    is_open = F.col("_blocking.n") > F.col("_last_success")
    state = state.withColumns(
        {"failure_count": F.col("_n") - F.col("_last_success"), "_block": F.when(is_open, F.col("_blocking"))}
    )
    until = plus_seconds(F.col("_block.ts"), cooling_seconds)
    is_blocked = F.col("_block").isNotNull()
    return state.select(
        "key",
        is_blocked.alias("is_blocked"),
        until.alias("blocked_until"),
        F.col("_block.status_code").alias("blocked_code"),
        "last_attempt",
        "last_success",
        "failure_count",
        "success_count",
        (~is_blocked | (F.lit(as_of).cast("timestamp") > until)).alias("can_run"),
    )
