"""Per-key computations that never need a whole key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the greatest by the order columns, combined map-side."""
    rest = [c for c in df.columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(newest).select(*key, "_row.*").select(*df.columns)


# a chunk with more rows is cut, if it is also more than a quarter of an even share
HOT_ROWS = 100_000
CUTS, BUCKETS = 16, 1000


def chunked(rows: DataFrame, key: list[str], chunk: Column, at: str) -> DataFrame:
    """Rows with `_chunk`: the chunk, and for those with very many rows ranges of the time `at`, measured by row counts.

    A hot chunk's time is counted in buckets, and neighbouring buckets are taken together to up to
    `CUTS` ranges of like size (more where one bucket is large); what is still hot is cut again. Equal times stay together.
    Only chunks beyond a quarter of an even share are cut, so the lists that reach the driver and are broadcast are no longer
    than a few times the number of shuffle partitions.
    """
    spark = rows.sparkSession
    marked, total = rows.withColumn("_chunk", chunk), rows.count()
    limit = max(HOT_ROWS, total // (4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    if total <= limit:
        return marked
    part, time = [*key, "_chunk"], F.unix_micros(at)
    while True:
        sizes = marked.groupBy(*part).agg(F.count("*").alias("_n"), F.min(time).alias("_low"), F.max(time).alias("_high"))
        hot = sizes.filter((F.col("_n") > limit) & (F.col("_low") < F.col("_high")))
        found = hot.collect()
        if not found:
            return marked
        hot = F.broadcast(spark.createDataFrame(found, hot.schema))
        bucket = F.floor((time - F.col("_low")) / (F.col("_high") - F.col("_low") + 1) * BUCKETS)
        counts = marked.join(hot, part).groupBy(*part, "_n", bucket.alias("_b")).agg(
            F.count("*").alias("_c"), F.min(time).alias("_start"))
        in_time = W.partitionBy(*part).orderBy("_b")
        before = F.sum("_c").over(in_time.rowsBetween(W.unboundedPreceding, -1))
        counts = counts.withColumns({"_share": F.floor(before * CUTS / F.col("_n")), "_large": F.col("_c") * CUTS > F.col("_n")})
        counts = counts.withColumns({"_last_share": F.lag("_share").over(in_time), "_after_large": F.lag("_large").over(in_time)})
        starts = counts.filter(F.col("_large") | F.col("_after_large") | (F.col("_share") > F.coalesce("_last_share", F.lit(0))))
        cuts = starts.groupBy(*part).agg(F.collect_list("_start").alias("_starts"))
        cuts = F.broadcast(spark.createDataFrame(cuts.collect(), cuts.schema))
        place = F.size(F.filter(F.coalesce("_starts", F.array().cast("array<bigint>")), lambda s: s <= time))
        marked = marked.join(cuts, part, "left").withColumn("_chunk", F.struct("_chunk", place.alias("_place"))).drop("_starts")


def running(
    rows: DataFrame,
    key: list[str],
    order: list[str],
    chunk: Column,
    sums: dict[str, Column],
    peers: bool = False,
    at: str | None = None,
) -> DataFrame:
    """Running sums per key, in the given order.

    The work is split by (key, chunk), where chunk must not fall as the order
    rises. Totals per chunk are small; they are accumulated per key and added to
    the running value inside the chunk. So the largest group is one chunk of
    one key, whatever share of the rows that key has; where the order begins with a
    time `at`, hot chunks are cut by it. Keys must not be NULL.
    With peers, rows of equal order see each other.
    """
    part = [*key, "_chunk"]
    marked = chunked(rows, key, chunk, at) if at else rows.withColumn("_chunk", chunk)

    totals = marked.groupBy(*part).agg(*[F.sum(v).alias(n) for n, v in sums.items()])
    earlier = W.partitionBy(*key).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        *part, *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before_{n}") for n in sums]
    )

    inside = W.partitionBy(*part).orderBy(*order)
    inside = (inside.rangeBetween if peers else inside.rowsBetween)(W.unboundedPreceding, W.currentRow)
    local = marked.select("*", *[F.sum(v).over(inside).alias(f"_inside_{n}") for n, v in sums.items()])
    return local.join(carried, part).select(
        *rows.columns, *[(F.col(f"_before_{n}") + F.col(f"_inside_{n}")).alias(n) for n in sums]
    )


def numbered(rows: DataFrame, key: list[str], order: list[str], chunk: Column, name: str) -> DataFrame:
    """Position 1..n of each row in its key; rows without a key are left out.

    Only keys with very many rows, found by their counts, are numbered by chunks. They are the largest of those with more than
    `HOT_ROWS` rows, at most four for each shuffle partition, so any other key is less than a quarter of an even share.
    """
    spark = rows.sparkSession
    rows = rows.dropna(subset=key)
    most = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy(*key).agg(F.count("*").alias("_n"))
    hot = sizes.filter(F.col("_n") > HOT_ROWS).orderBy(F.desc("_n")).limit(most).select(*key)
    found = hot.collect()
    place = F.row_number().over(W.partitionBy(*key).orderBy(*order)).cast("bigint")
    if not found:
        return rows.withColumn(name, place)
    hot = F.broadcast(spark.createDataFrame(found, hot.schema))
    many = running(rows.join(hot, key, "left_semi"), key, order, chunk, sums={name: F.lit(1).cast("bigint")})
    return rows.join(hot, key, "left_anti").withColumn(name, place).unionByName(many)
