"""Scans of listings and their child rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsubo import vocab
from tsubo.operators.paging import ordered


def all_listings(listings: DataFrame) -> DataFrame:
    """Every listing, removed ones too, newest first."""
    return listings.orderBy(F.col("created_at").desc(), F.col("id").desc())


def active_listings(listings: DataFrame) -> DataFrame:
    return listings.filter(F.col("status") == vocab.ACTIVE)


def by_id(listings: DataFrame, listing_id: str) -> DataFrame:
    return listings.filter(F.col("id") == listing_id)


def children_of(children: DataFrame, listing_id: str) -> DataFrame:
    return children.filter(F.col("property_id") == listing_id).orderBy("sort_order")


def with_children(listings: DataFrame, stations: DataFrame, images: DataFrame) -> DataFrame:
    """Each listing with its stations and images, one row per child.

    Flat rows keep a listing with very many children spread over tasks;
    a listing without children gives one row with a NULL kind.
    """
    children = stations.select(
        "property_id", F.lit("station").alias("kind"), "sort_order", F.col("station_name").alias("value"),
        "line_name", "walk_minutes",
    ).unionByName(
        images.select("property_id", F.lit("image").alias("kind"), "sort_order", F.col("image_url").alias("value")),
        allowMissingColumns=True,
    )
    # an inner join can split a hot listing's children, a left join could only split the listings
    joined = listings.join(children, listings["id"] == children["property_id"]).drop("property_id")
    # each id once, so that the children are not dealt out a second time
    parents = children.select("property_id").distinct()
    alone = listings.join(parents, listings["id"] == parents["property_id"], "left_anti")
    return joined.unionByName(alone, allowMissingColumns=True)


def listing_with_children(
    listings: DataFrame, stations: DataFrame, images: DataFrame, listing_id: str
) -> DataFrame:
    """The same for one listing; the id filter reaches every scan."""
    stations, images = (c.filter(F.col("property_id") == listing_id) for c in (stations, images))
    return with_children(by_id(listings, listing_id), stations, images)


def listing_frame(listings: DataFrame, *conditions, sort: str = "newest", status: str | None = None) -> DataFrame:
    """Unpaged list: no status default, any conditions, any sort mode."""
    if status is not None:
        listings = listings.filter(F.col("status") == status)
    for condition in conditions:
        listings = listings.filter(condition)
    return ordered(listings, sort)
