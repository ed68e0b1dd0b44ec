"""The listing search: filters, existence tests, order, page and total."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import NamedTuple

from pyspark.sql import DataFrame

from tsubo.operators import filters, joins, paging, scan, stats


@dataclass
class SearchOptions:
    station: str = ""
    line: str = ""
    max_walk: int | None = None
    walk_mode: str = "nearest"
    min_rent: int | None = None
    max_rent: int | None = None
    rent_unit: int = filters.YEN
    min_area: float | None = None
    max_area: float | None = None
    min_building_age: int | None = None
    max_building_age: int | None = None
    min_floor: int | None = None
    max_floor: int | None = None
    floor_plans: list[str] = field(default_factory=list)
    building_types: list[str] = field(default_factory=list)
    facilities: list[str] = field(default_factory=list)
    exclude_ids: list[str] | DataFrame = field(default_factory=list)
    sort: str = "newest"
    limit: int | None = None
    offset: int | None = None
    cursor: str = ""
    case_free: bool = False

    def check(self) -> "SearchOptions":
        for name in ("rent", "area", "building_age", "floor"):
            low, high = getattr(self, f"min_{name}"), getattr(self, f"max_{name}")
            if low is not None and high is not None and low > high:
                raise ValueError(f"min_{name} is above max_{name}")
        if self.sort not in paging.SORTS:
            raise ValueError(f"no such sort mode: {self.sort}")
        return self

    @property
    def by_any_station(self) -> bool:
        return bool(self.max_walk) and self.walk_mode == "any"


class SearchPage(NamedTuple):
    page: DataFrame
    total: DataFrame


def by_station(listings: DataFrame, stations: DataFrame | None, o: SearchOptions) -> DataFrame:
    """Station, line and walk may be met by different stations; all the station
    tests share one pass over the station table."""
    conditions = []
    if o.station:
        conditions.append(joins.text_contains("station_name", o.station, o.case_free))
    if o.line:
        conditions.append(joins.text_contains("line_name", o.line, o.case_free))
    if o.by_any_station:
        conditions.append(joins.walk_within(o.max_walk))
    elif o.max_walk:
        listings = filters.keep(listings, filters.nearest_walk(o.max_walk))
    return joins.having_stations(listings, stations, *conditions)


def matching(listings: DataFrame, stations: DataFrame | None, o: SearchOptions) -> DataFrame:
    """Active listings that meet every option; row filters come before the joins."""
    active = filters.keep(
        scan.active_listings(listings),
        filters.between("rent", o.min_rent, o.max_rent, o.rent_unit),
        filters.between("area", o.min_area, o.max_area),
        filters.between("building_age", o.min_building_age, o.max_building_age),
        filters.between("floor", o.min_floor, o.max_floor),
        filters.one_of("floor_plan", o.floor_plans),
        filters.one_of("building_type", o.building_types),
        filters.has_facilities(o.facilities),
    )
    return by_station(filters.without_ids(active, o.exclude_ids), stations, o)


def search(listings: DataFrame, stations: DataFrame | None, options: SearchOptions) -> SearchPage:
    """The page and the total before paging; two actions over one filtered frame."""
    o = options.check()
    rows = matching(listings, stations, o)
    return SearchPage(paging.page(rows, o.sort, o.limit, o.offset, o.cursor), stats.total(rows))


def next_cursor(page_rows: list, limit: int | None) -> str:
    """Cursor for the page after the collected one; '' when this was the last."""
    if len(page_rows) < paging.checked_limit(limit):
        return ""
    last = page_rows[-1]
    return paging.encode_cursor(last["fetched_at"], last["id"])


def unpaged(listings: DataFrame, stations: DataFrame | None, options: SearchOptions) -> DataFrame:
    """The older list: station, line and walk filters only, removed rows included."""
    return paging.ordered(by_station(listings, stations, options), options.sort)
