"""Code tables as small dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsubo import vocab
from tsubo.session import fixed_rows

_TABLES = {
    "facility_codes": vocab.FACILITY_CODES,
    "facility_labels": vocab.FACILITY_LABELS,
    "facility_names": vocab.FACILITY_NAMES,
    "change_labels": vocab.CHANGE_LABELS,
}


def dimension(spark: SparkSession, table: str) -> DataFrame:
    return fixed_rows(spark, list(_TABLES[table].items()), "code string, name string")


def named(spark: SparkSession, items: DataFrame, array_column: str, table: str) -> DataFrame:
    """Explode an array of codes and name each one; unknown codes drop out.

    The dimension is one of the fixed tables above (at most 80 rows), which is
    what makes the broadcast safe.
    """
    codes = items.withColumn("code", F.explode(array_column))
    return codes.join(F.broadcast(dimension(spark, table)), "code")
