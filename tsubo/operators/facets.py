"""Facet distributions as (field, value, n) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsubo import vocab


def facets(df: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Counts per field and value in one pass; NULL is not a value."""
    fields = list(fields or vocab.FACET_FIELDS)
    texts = df.select(*[F.col(f).cast("string").alias(f) for f in fields])
    long = texts.unpivot([], fields, "field", "value").filter(F.col("value").isNotNull())
    return long.groupBy("field", "value").agg(F.count("*").alias("n"))
