"""What each filter of a chain removes, in every order of the filters.

Every document fails some set of the filters, its mask. Documents are counted by (part, mask), so a part
has at most 32 cells whatever its size. The survivors of each of the 32 subsets of filters come from a
Gray-code walk: one filter is toggled at a time, each cell keeps the number of active filters it fails,
and the running survivors change by the cells whose number reaches or leaves zero. A step of any order
goes from one subset to the next, so its figures are differences of two stored states.

Cases: a null text is the empty text, a null part the empty string. Identical texts are those of equal
SHA-256; a row with a null doc_id is neither larger nor smaller than any, so it has no earlier copy.
Repeated rows count each; repeated labels of a document count once (it is good or toxic if one label says so). An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
LEAST_WORDS = 100
LEAST_DISTINCT_PERCENT = 80
MOST_CAPITALS_PERCENT = 10
MARKS = "[#$%&*|]"
COUNTS = ("n", "good", "toxic")
RESULT = ("part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, "
          "unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint")


def text_mask(text: Column) -> Column:
    """Failed filters that one text decides: bit 0 is A (short), B (repetitive), C (capitals), D (marks)."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    total, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", F.lit("")))
    failed = [total < LEAST_WORDS,
              100 * distinct.cast("bigint") < LEAST_DISTINCT_PERCENT * total.cast("bigint"),
              100 * capitals.cast("bigint") > MOST_CAPITALS_PERCENT * F.length(text).cast("bigint"),
              text.rlike(MARKS)]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents by the set of filters they fail.

    A text's first holder is one row per text (combined before the shuffle), met by an equality join on text and
    id, so a text that a third of all rows share is no single task.
    """
    marked = labels.groupBy(F.col("doc_id").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"),
        F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                       F.sha2(text, 256).alias("digest"), text_mask(text).alias("mask"))
    rows = rows.groupBy("id", "part", "digest", "mask").agg(F.count("*").alias("n"))
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    judged = rows.join(first, ["digest", "id"], "left").join(marked, "id", "left")
    copy = F.col("id").isNotNull() & F.col("first").isNull()
    number = F.col("n")
    return judged.groupBy("part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask")).agg(
        F.sum(number).alias("n"),
        F.sum(F.when(F.col("good") == 1, number).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic") == 1, number).otherwise(0)).alias("toxic"))


def survivors(counts: dict[int, tuple[int, ...]], filters: int = len(FILTERS)) -> list[tuple[int, ...]]:
    """Counts of documents that no filter of a subset removes, for every subset (as a bit set).

    One filter is switched on or off from one subset to the next; a cell enters or leaves the running
    totals when its number of active failures leaves or reaches zero.
    """
    width = len(next(iter(counts.values()), (0,)))
    active, running = dict.fromkeys(counts, 0), [sum(c[i] for c in counts.values()) for i in range(width)]
    states: list[tuple[int, ...]] = [()] * (1 << filters)
    subset = 0
    states[0] = tuple(running)
    for turn in range(1, 1 << filters):
        bit = turn & -turn  # the filter that the Gray code toggles
        subset ^= bit
        change = 1 if subset & bit else -1
        for mask, count in counts.items():
            if mask & bit:
                was = active[mask]
                active[mask] = was + change
                if was == 0 or active[mask] == 0:
                    for i in range(width):
                        running[i] -= change * count[i]
        states[subset] = tuple(running)
    return states


def steps(counts: dict[int, tuple[int, ...]], names: str = FILTERS) -> list[tuple]:
    """(filter order, step, kept, removed, redundant, unique fails, good lost, toxic lost, shapley) of every order."""
    states, every = survivors(counts, len(names)), (1 << len(names)) - 1
    total = states[0][0]
    failing = {f: total - states[1 << i][0] for i, f in enumerate(names)}
    alone = {f: states[every ^ 1 << i][0] - states[every][0] for i, f in enumerate(names)}
    found, shares = [], dict.fromkeys(names, 0)
    for order in permutations(names):
        subset = 0
        for step, f in enumerate(order, 1):
            before = states[subset]
            subset |= 1 << names.index(f)
            after = states[subset]
            removed, good, toxic = (b - a for b, a in zip(before, after))
            shares[f] += removed
            found.append(("".join(order), step, after[0], removed, failing[f] - removed, alone[f], good, toxic, f))
    return [(*row[:-1], shares[row[-1]]) for row in found]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step."""
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = {int(m): tuple(map(int, c)) for m, *c in pdf[["mask", *COUNTS]].itertuples(index=False)}
        rows = pd.DataFrame(steps(counts), columns=[c.split()[0] for c in RESULT.split(", ")[1:]])
        rows.insert(0, "part", pdf["part"].iloc[0])
        return rows

    # a group is the at most 32 cells of a part
    return cells(docs, labels).groupBy("part").applyInPandas(walk, RESULT)
