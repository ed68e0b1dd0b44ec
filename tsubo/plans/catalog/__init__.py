"""Every operator as a query over the supplied tables, with SQL to compare."""

from __future__ import annotations

from tsubo.plans.catalog import history, pages, queue, search, stats, streams, tables, values  # noqa: F401
from tsubo.plans.catalog.base import CATALOG

__all__ = ["CATALOG"]
