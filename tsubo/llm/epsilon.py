"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors with cosine c are sqrt(2 - 2c) apart. Vectors are projected on leading principal directions
(fitted on a bounded sample; any orthonormal directions are right, good ones prune more) and sorted
by the cells of a grid of that width: the epsilon grid order. The sorted sequence is cut into
intervals, intervals into larger ones, and so on. Starting from the largest, pairs of intervals are
joined by their children; a pair whose bounding boxes are farther apart than epsilon is dropped,
because projection never lengthens a distance. Surviving pairs of small intervals are compared by
matrix products, in double precision. Block pairs are dealt out in tiles, so a block is sent once per tile,
not once per pair. No pair of vectors leaves a task: only counts per vector and the edges of a
spanning forest do.

Vectors of unlike length are never linked: the length is the first coordinate of the grid order, each
length has directions of its own, and those without a vector in the sample take the first components.

Equal vectors are one class; a class counts once per member.

Cases: a vector that is null, zero, or holds null or non-finite components links with nothing. Repeated ids are vectors of their own for the
counts and share one row's component by their vector; an empty table gives no rows. Other columns
are kept out of the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsubo.llm.common import components, ranked, stored

LEAST_COSINE = 0.95
SAMPLE = 4096
DIRECTIONS = 6
BLOCK = 1024
FANOUT = 8
GROUP = 16


def directions(vectors: DataFrame, sample: int = SAMPLE, most: int = DIRECTIONS) -> dict[int, np.ndarray]:
    """Leading principal directions by vector length, from at most `sample` usable vectors (smallest id hashes)."""
    usable = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(
        "embedding IS NOT NULL AND exists(embedding, x -> x <> 0)"
        " AND forall(embedding, x -> x IS NOT NULL AND abs(x) < double('Infinity'))")
    rows = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toPandas()["embedding"]
    by_length: dict[int, list] = {}
    for row in rows:
        by_length.setdefault(len(row), []).append(np.asarray(row, dtype=np.float64))
    found = {}
    for width, some in by_length.items():
        x = unit_vectors(np.stack(some))
        x = x - x.mean(axis=0)
        _, axes = np.linalg.eigh(x.T @ x)
        found[width] = axes[:, ::-1][:, :min(most, width)].copy()
    return found


def unit_vectors(data: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    data = data.astype(np.float64)
    scale = np.abs(data).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    data = data / scale
    return data / np.linalg.norm(data, axis=1, keepdims=True)


def cells(vectors: DataFrame, axes: dict[int, np.ndarray], epsilon: float, most: int = DIRECTIONS) -> DataFrame:
    """vec_id, vector (binary doubles of the unit vector; null if it links with nothing), at (coordinates), cell.

    The first coordinate keeps lengths apart; it is at least 4 between unlike lengths, twice the widest epsilon.
    """
    def run(batches):
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            n = len(ids)
            if pa.types.is_large_list(column.type):
                column = column.cast(pa.list_(column.type.value_type))
            sizes = np.where(np.asarray(column.is_null()), 0, np.diff(column.offsets.to_numpy()))
            vector, point, cell = [None] * n, [None] * n, [None] * n
            for width in np.unique(sizes[sizes > 0]).tolist():
                good = sizes == width
                flat = column.filter(pa.array(good)).flatten()
                data = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)  # nulls become nan
                usable = np.isfinite(data).all(axis=1) & (data != 0).any(axis=1)
                where = np.flatnonzero(good)[usable]
                if not len(where):
                    continue
                unit = unit_vectors(data[usable])
                at = np.zeros((len(where), most + 1))
                at[:, 0] = 4.0 * width
                own = unit @ axes[width] if width in axes else unit[:, :most]
                at[:, 1:1 + own.shape[1]] = own
                grid = np.floor(at / epsilon).astype(np.int32)
                for k, i in enumerate(where):
                    vector[i], point[i], cell[i] = unit[k].tobytes(), at[k].tolist(), grid[k].tolist()
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(vector, pa.binary()), pa.array(point, pa.list_(pa.float64())), pa.array(cell, pa.list_(pa.int32()))],
                names=["vec_id", "vector", "at", "cell"])

    return vectors.select(F.col("vec_id").cast("bigint"), F.col("embedding").cast("array<double>")).mapInArrow(
        run, "vec_id bigint, vector binary, at array<double>, cell array<int>")


def _boxes(rows: DataFrame, key: str, dims: int, low: str, high: str) -> DataFrame:
    """Bounding boxes (arrays lo, hi) per key."""
    return rows.groupBy(key).agg(
        *[F.min(F.get(low, F.lit(i))).alias(f"l{i}") for i in range(dims)],
        *[F.max(F.get(high, F.lit(i))).alias(f"h{i}") for i in range(dims)]).select(
        key, F.array(*[f"l{i}" for i in range(dims)]).alias("lo"), F.array(*[f"h{i}" for i in range(dims)]).alias("hi"))


def interval_pairs(boxes: DataFrame, dims: int, epsilon: float, fanout: int = FANOUT) -> DataFrame:
    """Pairs (a <= b) of intervals that may hold vectors within epsilon of each other.

    boxes(block, lo, hi). Larger intervals are built until at most `fanout` are left; their pairs
    are joined by children, level by level. A pair makes at most fanout^2 pairs below it.
    """
    levels = [boxes]
    while True:
        n = levels[-1].count()
        if n <= fanout:
            break
        up = levels[-1].withColumn("block", F.floor(F.col("block") / fanout))
        levels.append(stored(_boxes(up, "block", dims, "lo", "hi"), "ego-level"))
    gap = sum((F.pow(F.greatest(F.lit(0.0), F.get("a_lo", F.lit(i)) - F.get("b_hi", F.lit(i)), F.get("b_lo", F.lit(i)) - F.get("a_hi", F.lit(i))), 2)
               for i in range(dims)), F.lit(0.0))
    near = gap <= (epsilon * (1 + 1e-9)) ** 2
    top = levels[-1].agg(F.collect_list("block").alias("x")).first()["x"]  # at most `fanout`
    pairs = boxes.sparkSession.createDataFrame([(a, b) for a in top for b in top if a <= b] or [(-1, -1)], "pa bigint, pb bigint")
    for level in reversed(levels):
        parent = F.col("block") if level is levels[-1] else F.floor(F.col("block") / fanout)
        side = lambda s: level.select(parent.alias(f"p{s}"), F.col("block").alias(s), F.col("lo").alias(f"{s}_lo"), F.col("hi").alias(f"{s}_hi"))  # noqa: B023,E731
        found = pairs.join(side("a"), "pa").join(side("b"), "pb").where((F.col("a") <= F.col("b")) & near)
        pairs = stored(found.select(F.col("a").alias("pa"), F.col("b").alias("pb")), "ego-pairs")
    return pairs.select(F.col("pa").alias("a"), F.col("pb").alias("b"))


def _compare(a: tuple, b: tuple, same: bool, least: float):
    """Per vector: linked members of other classes, and a label that links it to what it is linked with."""
    (ids_a, n_a, x), (ids_b, n_b, y) = a, b
    linked = x @ y.T >= least
    if same:
        np.fill_diagonal(linked, False)
    if not linked.any():
        return None
    rows, cols = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(linked.any(axis=0))
    part = linked[np.ix_(rows, cols)]
    label_a, label_b = ids_a[rows].copy(), ids_b[cols].copy()
    top = np.iinfo(np.int64).max
    # the smallest id spreads over the links until nothing changes
    while True:
        new_b = np.minimum(label_b, np.where(part, label_a[:, None], top).min(axis=0))
        new_a = np.minimum(label_a, np.where(part, new_b[None, :], top).min(axis=1))
        if (new_a == label_a).all() and (new_b == label_b).all():
            break
        label_a, label_b = new_a, new_b
    out = [(ids_a[rows], part @ n_b[cols], label_a)]
    if not same:
        out.append((ids_b[cols], n_a[rows] @ part, label_b))
    return [np.concatenate(c) for c in zip(*out)]


def _by_length(row) -> dict[int, tuple]:
    """A packed block as vector length -> (ids, members, vectors)."""
    ids, members, widths = (np.frombuffer(x, np.int64) for x in (row.ids, row.members, row.widths))
    flat, ends, out = np.frombuffer(row.vectors, np.float64), np.cumsum(widths), {}
    for width in np.unique(widths).tolist():  # a block is sorted by length
        first, last = np.searchsorted(widths, [width, width + 1])
        out[width] = ids[first:last], members[first:last], flat[ends[first] - width:ends[last - 1]].reshape(-1, width)
    return out


def linked_classes(blocks: DataFrame, pairs: DataFrame, least: float, group: int = GROUP) -> DataFrame:
    """(vec_id, links, label) rows from comparing block pairs.

    Pairs are dealt out in tiles of `group` by `group` blocks. A task holds the left blocks of a tile and
    one right block at a time; a dense region is many tiles.
    """
    wanted = pairs.select(F.floor(F.col("a") / group).alias("ta"), F.floor(F.col("b") / group).alias("tb"), "a", "b")
    data = ["ids", "members", "widths", "vectors"]
    left = wanted.select("ta", "tb", "a").distinct().join(blocks.withColumnRenamed("block", "a"), "a").select(
        "ta", "tb", F.lit(None).cast("array<bigint>").alias("partners"), F.col("a").alias("block"), *data)
    right = wanted.groupBy("ta", "tb", "b").agg(F.collect_list("a").alias("partners")).join(  # at most `group`
        blocks.withColumnRenamed("block", "b"), "b").select("ta", "tb", "partners", F.col("b").alias("block"), *data)
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.unionByName(right).repartition(parts, "ta", "tb").sortWithinPartitions("ta", "tb", F.col("partners").isNotNull(), "block")

    def run(batches):
        held, tile = {}, None
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                if tile != (row.ta, row.tb):
                    held, tile = {}, (row.ta, row.tb)
                block = _by_length(row)
                if row.partners is None:
                    held[row.block] = block
                    continue
                for a in row.partners:
                    for width in held[a].keys() & block.keys():
                        found = _compare(held[a][width], block[width], a == row.block, least)
                        if found:
                            yield pd.DataFrame({"vec_id": found[0], "links": found[1], "label": found[2]})

    return dealt.mapInPandas(run, "vec_id bigint, links bigint, label bigint")


def near_duplicates(vectors: DataFrame, least: float = LEAST_COSINE, block: int = BLOCK, sample: int = SAMPLE,
                    most_directions: int = DIRECTIONS, fanout: int = FANOUT) -> DataFrame:
    """vec_id, n_links, component_id, kept per row of vectors(vec_id, embedding)."""
    epsilon = float(np.sqrt(2 - 2 * least))
    axes = directions(vectors, sample, most_directions)
    dims = most_directions + 1
    rows = stored(cells(vectors, axes, epsilon, most_directions).withColumn("same", F.md5("vector")), "ego-cells")
    usable = rows.where("vector IS NOT NULL AND vec_id IS NOT NULL")
    heads = usable.groupBy("same").agg(F.min("vec_id").alias("rep"), F.count("*").alias("members"))
    # a class's vector is looked up at its smallest id; an id repeated with one vector counts once here
    classes = usable.join(heads.select("same", "members", F.col("rep").alias("vec_id")), ["same", "vec_id"]).dropDuplicates(["same"])
    order = [F.get("cell", F.lit(i)) for i in range(dims)] + [F.col("vec_id"), F.col("same")]
    ordered = ranked(classes.select("vec_id", "members", "vector", "at", "cell", "same"), order, "position", "ego-order")
    ordered = ordered.withColumn("block", F.floor(F.col("position") / block))
    boxes = stored(_boxes(ordered, "block", dims, "at", "at"), "ego-boxes")
    pairs = interval_pairs(boxes, dims, epsilon, fanout)

    def packed(key, pdf):  # at most `block` rows
        pdf = pdf.sort_values("position")
        return pd.DataFrame({"block": [key[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()],
                             "members": [pdf["members"].to_numpy(np.int64).tobytes()],
                             "widths": [(pdf["vector"].str.len().to_numpy(np.int64) // 8).tobytes()],
                             "vectors": [b"".join(pdf["vector"])]})

    blobs = stored(ordered.groupBy("block").applyInPandas(
        packed, "block bigint, ids binary, members binary, widths binary, vectors binary"), "ego-blocks")
    found = stored(linked_classes(blobs, pairs, least), "ego-links")
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("vec_id").alias("a"), F.col("label").alias("b")), "ego-parts").withColumnRenamed("node", "vec_id")
    state = heads.select("same", "members", F.col("rep").alias("vec_id")).join(counts, "vec_id", "left").join(parts, "vec_id", "left").select(
        "same", (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"))
    return rows.select("vec_id", "same").join(state, "same", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"))
