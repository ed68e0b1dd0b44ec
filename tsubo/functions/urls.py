"""URL forms and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsubo import vocab
from tsubo.functions.text import once

_SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"
_UNREADABLE = r"[\x00-\x1F\x7F]|%(?![0-9A-Fa-f]{2})"


def _bare(url: Column) -> Column:
    """Without query and fragment."""
    return F.regexp_replace(url, r"(?s)[?#].*$", "")


def _readable(url: Column, form: Column) -> Column:
    """URLs with control characters or broken escapes are left as they came."""
    return F.when(_bare(url).rlike(_UNREADABLE), url).otherwise(form)


def storage_form(url: Column) -> Column:
    """No query, fragment or trailing slash, always https."""
    path = F.regexp_replace(_bare(url), r"/$", "")
    secure = F.concat(F.lit("https://"), F.regexp_replace(path, _SCHEME, ""))
    return _readable(url, secure)


def crawl_form(url: Column) -> Column:
    """No query or fragment; a trailing slash stays on detail pages and on a bare host."""
    def form(bare: Column) -> Column:
        slashless = F.regexp_replace(bare, r"^((?:[A-Za-z][A-Za-z0-9+.\-]*://[^/]*)?/.+)/$", "$1")
        return F.when(bare.contains("/rent/detail/"), bare).otherwise(slashless)

    return once(url, lambda url: once(_bare(url), lambda bare: F.when(bare.rlike(_UNREADABLE), url).otherwise(form(bare))))


def existence_form(url: Column) -> Column:
    """No query, fragment or trailing slash, scheme kept."""
    return _readable(url, F.regexp_replace(_bare(url), r"/$", ""))


_STEP = r"(?:(?!/detail/)[^?#])"
_DETAIL = rf"^{_STEP}*/detail/({_STEP}+?)/{{0,2}}(?:[?#].*)?$"


def detail_key(url: Column) -> Column:
    """The path part after the only /detail/, of any length; NULL when there is none."""
    return F.nullif(F.regexp_extract(url, f"(?s){_DETAIL}", 1), F.lit(""))


def source_id(url: Column) -> Column:
    """The page's own id when it has 40 to 48 characters, else a hash of the URL."""
    return once(detail_key(url), lambda key: F.when(F.octet_length(key).between(40, 48), key).otherwise(F.md5(url)))


def listing_id(source: Column, source_property_id: Column) -> Column:
    return F.md5(F.concat_ws(":", source, source_property_id))


def legacy_id(url: Column) -> Column:
    return F.md5(storage_form(url))


def has_page_id(source_property_id: Column) -> Column:
    """True for an id read from a page address, False for a hash fallback."""
    return F.length(source_property_id).between(40, 48)


def needs_id_refresh(source: Column, source_property_id: Column, site: str = vocab.SOURCE) -> Column:
    return ~has_page_id(source_property_id) & (source == site)
