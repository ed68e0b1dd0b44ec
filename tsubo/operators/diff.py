"""A crawl compared with the active listings."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsubo import vocab
from tsubo.operators.keyed import latest

COMPARED = ["title", "rent", "image_url"]


def crawl_diff(
    current: DataFrame,
    crawl: DataFrame,
    order: list[str],
    complete: bool = True,
    scope: Column | None = None,
    compared: list[str] | None = None,
) -> DataFrame:
    """id and kind: new, removed, updated or same.

    Removals are reported only for a complete crawl, and only for current rows
    inside the scope. The last row of an id in the crawl, by the order columns, wins.
    """
    compared = compared or COMPARED
    crawl = latest(crawl, ["id"], order)
    columns = ["id", *compared]
    active = current.filter(F.col("status") == vocab.ACTIVE)
    expected = scope if scope is not None else F.lit(True)
    old = active.select(*columns, expected.alias("_expected"), F.lit(True).alias("_old")).alias("old")
    new = crawl.select(*columns, F.lit(True).alias("_new")).alias("new")
    changed = functools.reduce(
        lambda a, b: a | b, [~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")) for c in compared]
    )
    gone = F.col("_expected") & F.lit(complete)
    kind = (
        F.when(F.col("_old").isNull(), "new")
        .when(F.col("_new").isNull(), F.when(gone, "removed"))
        .when(changed, "updated")
        .otherwise("same")
    )
    joined = old.join(new, "id", "full_outer").select("id", kind.alias("kind"))
    return joined.filter(F.col("kind").isNotNull())


def batch_result(diff: DataFrame, crawl: DataFrame) -> DataFrame:
    """Counts reported after a crawl; a row without id is an error."""
    from tsubo.operators.stats import metrics

    kinds = {k: F.count_if(F.col("kind") == k) for k in ("new", "removed", "updated")}
    seen = {"scraped": F.count("*"), "errors": F.count_if(F.col("id").isNull())}
    return metrics(crawl, seen).unionByName(metrics(diff.filter(F.col("id").isNotNull()), kinds))
