"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document draws the exponential key -ln(u) / weight from a hash of its id. Within its
source, documents in key order are taken until the token budget is met: whole epochs first, then
the head of the key order. A source is never sorted as a whole: words are summed per slice of
the key range, the slice in which the budget ends is found from these sums, sliced again,
and only the last slice is sorted.

Cases: null text has 0 words; a null source is a source of its own, last in order; repeated rows
count each time; an empty table gives no rows; other columns are kept out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsubo.llm.common import WORD, ranked, stored, uniform

SLICES = 256
LEVELS = 2
MOST_REPEATS = 3


def quality_weight(text: str = "text", size: str = "size") -> Column:
    """A document's quality from 0.1 to 1: longer texts of ordinary word length count more."""
    long = F.log1p(F.col(size).cast("double")) / F.log1p(F.lit(1000.0))
    mean = F.length(text) / F.greatest(F.col(size), F.lit(1))
    odd = F.when((mean > 15) | (mean < 2.5), 0.3).otherwise(1.0)
    return F.coalesce(F.greatest(F.lit(0.1), F.least(F.lit(1.0), long) * odd), F.lit(0.1))


def budgets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = MOST_REPEATS,
            share: float = 1.0) -> DataFrame:
    """sizes(source_key, source, source_size) with target: weights go round in source order; a
    target is at most `most` times the source, and what is above is shared by weight again."""
    order = [F.col("source").isNull().alias("_null"), F.col("source")]
    rows = ranked(sizes, order, "_place", "mix-sources")
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), (F.col("_place") % len(cycle) + 1).cast("int"))
    rows = stored(rows.withColumn("weight", weight).drop("_place"), "mix-weights")
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    cap = most * F.col("source_size").cast("double")
    rate = 0.0
    # every round fixes at least one more source, so this ends; there are rarely more than a few
    while True:
        full = cap <= F.lit(rate) * F.col("weight")
        fixed, rest = rows.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if not rest:
            break
        after = max(rate, (total - (fixed or 0.0)) / rest)
        if after <= rate:
            break
        rate = after
    return rows.withColumn("target", F.least(cap, F.lit(rate) * F.col("weight")))


def mix(docs: DataFrame, weight: Column | None = None, seed: int = 17, share: float = 1.0,
        cycle: tuple[int, ...] = (1, 2, 3), most: int = MOST_REPEATS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, times and the columns to carry, per document.

    taken = times * size; times = whole epochs, plus 1 for documents at the head of the key order. The
    document at the budget's end is taken if that comes nearer to the target.
    """
    extra = [F.col(c).alias(f"carry_{c}") for c in carry]
    sized = docs.select("doc_id", "source", "text", *extra, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))
    key = -F.log(uniform(F.col("doc_id"), F.lit(seed))) / (quality_weight() if weight is None else weight)
    rows = stored(sized.select(
        "doc_id", "source", "size", key.alias("key"),
        F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit(""))).alias("source_key"),
        *[f"carry_{c}" for c in carry]), "mix-rows")
    # a place in (0, 1] that rises with the key
    place = 1 - F.exp(-F.col("key") / 2)
    slices = [F.least(F.floor(place * SLICES**(i + 1)), F.lit(SLICES**(i + 1) - 1)) % SLICES for i in range(LEVELS)]

    sizes = rows.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    state = budgets(sizes, cycle, most, share).select(
        "source_key", "source_size", "target",
        F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)).alias("epochs"))
    state = state.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size"))

    inside = F.lit(True)
    for level, piece in enumerate(slices):
        cut = f"cut{level}"
        here = rows.withColumn("piece", piece)
        if level:
            here = here.join(state.select("source_key", *[f"cut{i}" for i in range(level)]), "source_key").where(inside)
        totals = here.groupBy("source_key", "piece").agg(F.sum("size").alias("words"))
        running = W.partitionBy("source_key").orderBy("piece").rowsBetween(W.unboundedPreceding, -1)
        ends = totals.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0))).join(
            state.select("source_key", "left"), "source_key").where(
            (F.col("before") <= F.col("left"))).groupBy("source_key").agg(
            F.max_by(F.struct(F.col("piece").alias(cut), "before"), "piece").alias("e")).select("source_key", "e.*")
        state = stored(state.join(ends, "source_key", "left").withColumn("left", F.col("left") - F.coalesce("before", F.lit(0))).drop("before"), "mix-state")
        inside = inside & (piece == F.col(cut))

    joined = rows.join(state, "source_key")
    earlier = F.lit(False)
    for level in reversed(range(LEVELS)):
        earlier = (slices[level] < F.col(f"cut{level}")) | ((slices[level] == F.col(f"cut{level}")) & earlier)
    plain = joined.where(~inside | F.col(f"cut{LEVELS - 1}").isNull()).withColumn(
        "again", F.coalesce(earlier, F.lit(False)))
    order = W.partitionBy("source_key").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    last = joined.where(inside).withColumn("_before", F.coalesce(F.sum("size").over(order), F.lit(0)))
    last = last.withColumn("again", F.col("_before") + F.col("size") / 2.0 <= F.col("left")).drop("_before")
    times = (F.col("epochs") + F.col("again").cast("int")).cast("int")
    return plain.unionByName(last).select(
        "doc_id", "source", "size", "source_size", "target", (times * F.col("size")).cast("bigint").alias("taken"),
        times.alias("times"), *[F.col(f"carry_{c}").alias(c) for c in carry])
