"""Readers and writers of the listing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tsubo import schemas, vocab
from tsubo.functions.text import strip


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A Parquet table with its explicit schema."""
    return spark.read.schema(schemas.TABLES[table]).parquet(path)


def write_version(df: DataFrame, path: str, table: str, partition_by: list[str] | None = None) -> None:
    """Write a new version of a table; an existing folder is an error, so a
    version that is still being read is never overwritten."""
    writer = schemas.conform(df, table).write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def url_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of a URL list: trimmed, without blanks and comments."""
    url = strip(F.col(column)).alias("url")
    return lines.select(url).filter((F.col("url") != "") & ~F.col("url").startswith("#"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    return url_lines(spark.read.text(path))


def index_documents(listings: DataFrame) -> DataFrame:
    """The columns a search index holds."""
    return listings.select(*[c for c in vocab.INDEX_FIELDS if c in listings.columns])


def index_updates(saved: DataFrame, gone: DataFrame) -> DataFrame:
    """What a search index has to change: (id, action, document), documents as JSON to put for the
    saved listings, and the ids to delete of those that are gone."""
    docs = index_documents(saved)
    put = docs.select("id", F.lit("put").alias("action"), F.to_json(F.struct(*docs.columns)).alias("document"))
    return put.unionByName(gone.select("id", F.lit("delete").alias("action"), F.lit(None).cast("string").alias("document")))


def export_index(listings: DataFrame, path: str, fmt: str = "parquet") -> dict[str, int]:
    """Write the index documents of all listings and count them in the same pass.

    A row without id cannot be indexed and counts as failed.
    """
    seen = Observation("index_export")
    counts = [F.count("*").alias("total"), F.count("id").alias("indexed")]
    docs = index_documents(listings).observe(seen, *counts).filter(F.col("id").isNotNull())
    docs.write.format(fmt).mode("errorifexists").save(path)
    got = seen.get
    return {**got, "failed": got["total"] - got["indexed"]}


def json_rows(df: DataFrame, *columns: str) -> DataFrame:
    """Each row as one JSON text, NULL fields left out."""
    names = columns or df.columns
    return df.select(F.to_json(F.struct(*names)).alias("json"))


def json_answer(rows: DataFrame, name: str) -> DataFrame:
    """A page of rows as one JSON object {name: [...], count: n}.

    Takes an already paged frame and cuts nothing; whole tables go through json_rows.
    """
    items = F.collect_list(F.struct(*rows.columns))
    return rows.agg(F.to_json(F.struct(items.alias(name), F.count("*").alias("count"))).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").json(path)
