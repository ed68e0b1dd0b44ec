"""Structured Streaming jobs over request, outcome and snapshot streams.

Three forms of state, none of which grows with the rows that have passed:

- mergeable partial rows (window counts, queue state): a micro-batch is reduced to one row per key, written
  under the batch's number, and from time to time all partial rows are merged into a new base;
- a stateful processor per key (streaks and rates, snapshot changes): what the next rows need, in
  the state store; results go to a table under the batch's number;
- keys seen by day (distinct events): a micro-batch is compared with the days it names.

A replayed batch overwrites its own rows. Results do not depend on how a table is cut into files or in which
order those arrive: a late row corrects the result. Base and batch folders below the last base are no longer read.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import DateType, StructField, StructType

from tsubo import vocab
from tsubo.operators import history, queue, telemetry
from tsubo.operators.keyed import latest
from tsubo.streaming.processors import PROGRESS, Days, Progress

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
BATCHES_PER_BASE = 16
BEFORE_ALL = -(1 << 62)  # the place of a request without a time


def file_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 16) -> DataFrame:
    """A Parquet table, one file or a folder of files, as a stream; the trigger size bounds a micro-batch."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # a pattern, because a plain path must be a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{{{name}}}.parquet")


def finish(started: StreamingQuery) -> None:
    """Wait for a query that reads what is there and ends."""
    started.awaitTermination()


def _empty(stream: DataFrame) -> DataFrame:
    return stream.sparkSession.createDataFrame([], stream.schema)


def _each_batch(stream: DataFrame, root: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return (
        stream.writeStream.outputMode("append")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def _write_rows(stream: DataFrame, root: str) -> StreamingQuery:
    """Rows of each micro-batch under its number."""
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows/batch={number}")

    # an empty first batch, so that a stream without rows can be read
    write(_empty(stream), -1)
    return _each_batch(stream, root, write)


def read_rows(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all micro-batches."""
    return spark.read.parquet(f"{root}/rows").drop("batch", "seen_on")


# ---------------------------------------------------- mergeable partial rows
Reduce = Callable[[DataFrame], DataFrame]


def _write_partials(stream: DataFrame, root: str, partial: Reduce, merge: Reduce, every: int) -> StreamingQuery:
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        partial(batch).write.mode("overwrite").parquet(f"{root}/rows/batch={number}")
        if number % every == every - 1:
            merge(_partials(spark, root, number)).write.mode("overwrite").parquet(f"{root}/base/upto={number}")

    nothing = partial(_empty(stream))
    nothing.write.mode("overwrite").parquet(f"{root}/rows/batch=-1")
    merge(nothing).write.mode("overwrite").parquet(f"{root}/base/upto=-1")
    return _each_batch(stream, root, write)


def _partials(spark: SparkSession, root: str, batch: int | None = None) -> DataFrame:
    """The last base (before the batch that is being written) and the partial rows since."""
    base = spark.read.parquet(f"{root}/base")
    written = [int(re.search(r"upto=(-?\d+)", f)[1]) for f in base.inputFiles()]
    upto = max(n for n in written if batch is None or n < batch)
    rows = spark.read.parquet(f"{root}/rows").filter(F.col("batch") > upto)
    return base.filter(F.col("upto") == upto).drop("upto").unionByName(rows.drop("batch"))


# ------------------------------------------------------- requests per window
def _merged_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key", "minute").agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"))


def write_counts(requests: DataFrame, root: str, every: int = BATCHES_PER_BASE) -> StreamingQuery:
    """Requests and failures per key and minute; windows are rolled up from minutes when they are read.

    Minutes of late rows are further partial rows, so nothing waits for a watermark and no row is lost.
    """
    def partial(batch: DataFrame) -> DataFrame:
        timed = batch.filter(F.col("ts").isNotNull())
        return timed.groupBy("key", F.date_trunc("minute", "ts").alias("minute")).agg(
            F.count("*").alias("n"), F.count_if("failed").alias("failed"))

    return _write_partials(requests, root, partial, _merged_counts, every)


def read_counts(spark: SparkSession, root: str, size: str, slide: str | None = None) -> DataFrame:
    """Windows of whole minutes with their counts; with slide the windows overlap (trailing)."""
    minutes = _merged_counts(_partials(spark, root))
    span = F.window("minute", size, slide) if slide else F.window("minute", size)
    return (
        minutes.groupBy("key", span.alias("span"))
        .agg(F.sum("n").alias("n"), F.sum("failed").alias("failed"))
        .select("key", F.col("span.start").alias("start"), F.col("span.end").alias("end"), "n", "failed")
    )


# ------------------------------------------------------- streak and last 20
def write_progress(requests: DataFrame, root: str, late: str = "1 hour", last: int = vocab.FAILURE_WINDOW) -> StreamingQuery:
    """Streak and recent rate of each request, by a stateful processor per key.

    Requests are released in order once the watermark (`late` behind the newest) has passed them. The watermark
    column does not reach the processor, so that it sees late requests too and can hand them on.
    """
    timed = requests.withColumn("_seen", F.col("ts")).withWatermark("_seen", late)
    at = F.coalesce(F.unix_micros("ts"), F.lit(BEFORE_ALL))
    rows = timed.select(F.col("key").cast("bigint").alias("key"), at.alias("at"), F.col("id").cast("bigint").alias("id"), "failed")
    progressed = rows.groupBy("key").transformWithState(Progress(last), PROGRESS, "Append", "EventTime")
    return _write_rows(progressed, root)


def read_progress(spark: SparkSession, root: str, last: int = vocab.FAILURE_WINDOW) -> DataFrame:
    """Counters, streak and recent failure rate of every request that has arrived.

    Released requests are read as they are, and those that wait as last shown. Only keys with late requests are
    counted again, from their own rows; that work is split by key and time.
    """
    result = ["key", "id", "n", "failures", "streak", "recent_rate"]
    rows = spark.read.parquet(f"{root}/rows").drop("batch")
    is_late = F.col("part") == "late"
    late_keys = rows.filter(is_late).select("key").distinct()
    shown = rows.filter(~is_late)
    last_turn = shown.groupBy("key").agg(F.max("turn").alias("_last"))
    waiting = shown.filter("part = 'waiting'").join(last_turn, "key").filter("turn = _last").drop("_last")
    known = shown.filter("part = 'done'").unionByName(waiting)
    again = known.unionByName(rows.filter(is_late)).join(late_keys, "key", "left_semi").select(
        "key", F.when(F.col("at") > BEFORE_ALL, F.timestamp_micros("at")).alias("ts"), "id", "failed",
        F.lit(None).cast("int").alias("status_code"))
    rates = telemetry.recent_failure_rate(again, last).select("key", "id", "recent_rate")
    counted = telemetry.progress(again).select("key", "id", "n", "failures", "streak").join(rates, ["key", "id"])
    return known.join(late_keys, "key", "left_anti").select(*result).unionByName(counted.select(*result))


# -------------------------------------------------------------- queue state
def write_outcomes(outcomes: DataFrame, root: str, order: tuple[str, ...] = ("at",), every: int = BATCHES_PER_BASE) -> StreamingQuery:
    """A summary of the outcomes of each item, folded in the order of their time."""
    return _write_partials(outcomes, root, lambda batch: queue.summary(batch, order), queue.merged_summaries, every)


def read_queue(start: DataFrame, root: str) -> DataFrame:
    """The queue after all outcomes that have arrived; only summaries are read."""
    return queue.apply_summaries(start, queue.merged_summaries(_partials(start.sparkSession, root)))


# ------------------------------------------------------ snapshot change feed
def write_snapshots(snapshots: DataFrame, root: str, order: list[str]) -> StreamingQuery:
    """Each day that a micro-batch changes, and the day after it, beside the snapshot before them.

    The last row of a listing and day counts, by the order columns, whatever batch it comes with.
    """
    kinds = {f.name: f.dataType for f in snapshots.schema}
    fields = [f.column for f in history.FIELDS if f.column in kinds]
    shown = StructType(
        [StructField("property_id", kinds["property_id"]), StructField("snapshot_at", DateType())]
        + [StructField(f, kinds[f]) for f in fields]
        + [StructField("old_at", DateType())]
        + [StructField(f"old_{f}", kinds[f]) for f in fields])
    rows = snapshots.select("property_id", "snapshot_at", *order, *fields).filter(F.col("snapshot_at").isNotNull())
    compared = rows.groupBy("property_id").transformWithState(Days(order, fields), shown, "Append", "None")
    return _write_rows(compared, root)


def read_changes(spark: SparkSession, root: str) -> DataFrame:
    """The change log of all days that have arrived."""
    rows = latest(spark.read.parquet(f"{root}/rows"), ["property_id", "snapshot_at"], ["batch"])
    fields = [c for c in rows.columns if f"old_{c}" in rows.columns]
    before = F.when(F.col("old_at").isNotNull(), F.struct(F.col("old_at"), *[F.col(f"old_{f}").alias(f) for f in fields]))
    return history.change_log(history.with_changes(rows.withColumn("_old", before)))


# --------------------------------------------------------------- duplicates
def write_distinct(requests: DataFrame, root: str, key: list[str], days: int = 1) -> StreamingQuery:
    """Drop repeats of a key, however late they come.

    Repeats carry times at most `days` days apart, so a micro-batch is compared with the keys seen on its own days
    and that many around them; other days are not read. The written rows themselves are the keys seen.
    """
    spark = requests.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.dropDuplicates(key).withColumn("seen_on", F.to_date("ts"))
        own = [r[0] for r in rows.select("seen_on").distinct().collect()]  # as many as the batch has days
        near = sorted({d + timedelta(i) for d in own if d for i in range(-days, days + 1)})
        seen = spark.read.parquet(f"{root}/rows").filter((F.col("batch") < number) & (F.col("seen_on").isin(near) | F.col("seen_on").isNull()))
        fresh = rows.join(seen.select(*key), key, "left_anti")
        fresh.write.mode("overwrite").partitionBy("seen_on").parquet(f"{root}/rows/batch={number}")

    _empty(requests).write.mode("overwrite").parquet(f"{root}/rows/batch=-1/seen_on=1970-01-01")
    return _each_batch(requests, root, write)
