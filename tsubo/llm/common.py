"""Helpers the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tsubo.session import work_dir

# ASCII white space, the word separator of every word contract; bytes.split() uses the same set
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """The frame as a compressed table in the shared folder: it cuts lineage and outlives executors."""
    path = work_dir(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_bytes(column: str | Column = "text") -> Column:
    """UTF-8 bytes of a text, empty for null."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit("")).cast("binary")


def uniform(*columns: Column) -> Column:
    """A reproducible number in (0, 1) from the given values."""
    return (F.shiftrightunsigned(F.xxhash64(*columns), 11).cast("double") + 0.5) / float(1 << 53)


def ranked(df: DataFrame, order: list[Column], name: str, label: str) -> DataFrame:
    """The rows with their global position (from 0) in the given order, without a one-task sort.

    Rows are dealt out by ranges; a position is the place in the range plus the rows of earlier
    ranges. Only one count per range reaches the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = stored(
        df.repartitionByRange(parts, *order).sortWithinPartitions(*order).select(
            "*", F.spark_partition_id().alias("_rank_range"),
            F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_rank_place")), label)
    sizes = {r["_rank_range"]: r["n"] for r in sorted_rows.groupBy("_rank_range").agg(F.count("*").alias("n")).collect()}
    before, start = {}, 0
    for key in sorted(sizes):
        before[key], start = start, start + sizes[key]
    offsets = F.array(*[F.lit(before.get(i, 0)).cast("bigint") for i in range(max(sizes, default=0) + 1)])
    return sorted_rows.withColumn(name, F.get(offsets, F.col("_rank_range")) + F.col("_rank_place")).drop("_rank_range", "_rank_place")


# ------------------------------------------------------------------ memory of Python workers
class PerWorker:
    """What make() gives, made once for the tasks that a Python worker runs of one job.

    It travels as a broadcast. A worker drops that, and what was made with it, at its first task of another job, so
    that workers that wait or go on with other work do not hold it.
    """

    def __init__(self, make):
        self.make, self.made = make, None

    def __call__(self):
        if self.made is None:
            self.made = self.make()
        return self.made


def give_back() -> None:
    """Returns freed memory to the system, where the C library can; else a worker keeps most of what it once needed."""
    with contextlib.suppress(AttributeError, OSError, TypeError):
        ctypes.CDLL(None).malloc_trim(0)


# ------------------------------------------------------------------ hashing in Python tasks
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(values: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64 on an array of uint64 (wraps around)."""
    z = values + _MIX
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


_STEP = 0xD6E8FEB86659FD93
_BACK = pow(_STEP, -1, 1 << 64)


_grown: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """At least n powers of a base; a worker keeps the longest table it needed."""
    if len(_grown.get(base, ())) < n:
        powers = np.full(1 << n.bit_length(), base, np.uint64)
        powers[0] = 1
        _grown[base] = np.cumprod(powers, dtype=np.uint64)
    return _grown[base]


_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BYTES = mix(np.arange(256, dtype=np.uint64))
_SHORT = 64


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and the number of words of each text.

    A word's hash is a difference of two prefix sums over its bytes; words of more than 64 bytes are hashed one
    by one, as long runs can be made to collide in such sums. At most a megabyte is summed at a time.
    """
    import xxhash

    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = np.ones(len(data) + 1, bool)
    np.take(_SPACE, data, out=space[1:])
    edges = np.flatnonzero(space[1:] != space[:-1])
    begin, end = edges[::2], edges[1::2]
    hashes = np.empty(len(begin), np.uint64)
    long = np.flatnonzero(end - begin > _SHORT)
    done = 0
    while done < len(begin):
        base = begin[done]
        upto = max(int(np.searchsorted(end, base + (1 << 20), "right")), done + 1)
        first, last = begin[done:upto] - base, np.minimum(end[done:upto], begin[done:upto] + _SHORT) - base
        sums = Windows(_BYTES[data[base:base + last[-1]]])
        hashes[done:upto] = mix(sums.between(first, last) + (last - first).astype(np.uint64))
        done = upto
    for i in long.tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[begin[i]:end[i]].tobytes())
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return hashes, np.diff(np.searchsorted(begin, np.r_[0, ends]))


class Windows:
    """Hashes of runs of words at any place and width, from one prefix sum; equal runs have equal hashes."""

    def __init__(self, words: np.ndarray):
        self.up, down = (_powers(base, len(words) + 1) for base in (_STEP, _BACK))
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * down[:len(words)], out=self.sums[1:])

    def between(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[first]) * self.up[first]

    def at(self, places: np.ndarray, width: int) -> np.ndarray:
        return mix(self.between(places, places + width))

    def every(self, width: int) -> np.ndarray:
        n = max(len(self.sums) - width, 0)
        return mix((self.sums[width:] - self.sums[:n]) * self.up[:n])


# ------------------------------------------------------------------ connected components
def local_forest(pairs: np.ndarray) -> np.ndarray:
    """Pairs (node, smallest node of its part) of the graph in one batch; as many as nodes at most."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs.tolist():
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    found = [(x, root(x)) for x in parent]
    return np.array([p for p in found if p[0] != p[1]], dtype=np.int64).reshape(-1, 2)


def components(links: DataFrame, label: str) -> DataFrame:
    """(node, component) for every node in links(a, b): the smallest node reachable.

    Parts are first found inside each partition, then merged by alternating large-star and
    small-star rounds, each written to the shared folder. A node's links are reduced to its smallest
    neighbour by an aggregate, so a node with very many links is no single task.
    """
    import pandas as pd

    def forest(batches):
        kept, size = [], 0
        for pdf in batches:
            kept.append(pdf[["a", "b"]].to_numpy(np.int64))
            size += len(pdf)
            if size > 200_000:
                kept = [local_forest(np.concatenate(kept))]
                size = len(kept[0])
                if size > 150_000:
                    yield pd.DataFrame(kept[0], columns=["a", "b"])
                    kept, size = [], 0
        if kept:
            yield pd.DataFrame(local_forest(np.concatenate(kept)), columns=["a", "b"])

    clean = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(clean.mapInPandas(forest, "a bigint, b bigint"), label)  # a > b
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")),
                              F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        after = stored(small.where("a <> b").distinct(), label)
        # done when every node points at one root and no root points further
        tips = after.groupBy("a").agg(F.count("*").alias("n"))
        open_ends = tips.where("n > 1").select("a").unionByName(
            after.select(F.col("b").alias("a")).join(after.select("a"), "a", "left_semi"))
        edges = after
        if open_ends.isEmpty():
            break
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots).distinct()
