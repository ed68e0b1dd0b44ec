"""Typed rows from a table of pages: pages(page_id, url, html)."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsubo import vocab
from tsubo.functions import attributes, text, urls


# ------------------------------------------------------------- page parts ---
def _tag(html: Column, tag: str, attribute: str, value: str) -> Column:
    """First start tag that has the attribute with the value, or an empty text."""
    return F.regexp_extract(html, rf"""(?is)<{tag}\b[^>]*\b{attribute}\s*=\s*["']{value}["'][^>]*>""", 0)


def _attribute(tag: Column, name: str) -> Column:
    value = F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*(["'])(.*?)\1""", 2)
    return text.unescape_html(value)


def _filled(value: Column) -> Column:
    return text.once(text.strip(value), text.blank_to_null)


def _element_text(html: Column, tag: str) -> Column:
    inner = F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1)
    return text.visible_text(inner)


def head_tags(html: Column) -> Column:
    """The meta and link tags of a page, one after the other. `_tag` finds in them what it finds in the page."""
    return F.array_join(F.regexp_extract_all(html, F.lit(r"(?is)<(?:meta|link)\b[^>]*>"), 0), "")


def page_title(html: Column, tags: Column | None = None) -> Column:
    """og:title, then twitter:title, then title, then h1, then a fixed text.

    Where several columns need them, `tags` are the head_tags() of the page, made in a step before.
    """
    tags = html if tags is None else tags
    return F.coalesce(
        _filled(_attribute(_tag(tags, "meta", "property", "og:title"), "content")),
        _filled(_attribute(_tag(tags, "meta", "name", "twitter:title"), "content")),
        _filled(_element_text(html, "title")),
        _filled(_element_text(html, "h1")),
        F.lit(vocab.NO_TITLE),
    )


def cleaned_page_title(html: Column, tags: Column | None = None) -> Column:
    return F.coalesce(text.blank_to_null(text.clean_title(page_title(html, tags))), F.lit(vocab.NO_TITLE))


def page_address(url: Column, html: Column, tags: Column | None = None) -> Column:
    """Canonical link when the page names one, else its own URL; crawl form."""
    canonical = _filled(_attribute(_tag(html if tags is None else tags, "link", "rel", "canonical"), "href"))
    return urls.crawl_form(F.coalesce(canonical, url))


# -------------------------------------------------------------- list pages --
def listed_urls(pages: DataFrame, base: str = vocab.DETAIL_BASE) -> DataFrame:
    """(page_id, pos, url) of the detail pages a list page offers.

    Ids stand in checkbox values of 40 or more characters; the first position
    of an address counts.
    """
    boxes = F.regexp_extract_all("html", F.lit(rf"(?is)<input\b[^>]*\b{vocab.CHECKBOX_CLASS}\b[^>]*>"), 0)
    values = F.transform(boxes, lambda box: _attribute(box, "value"))
    long_enough = F.filter(values, lambda v: F.octet_length(v) >= 40)
    found = F.array_distinct(F.transform(long_enough, lambda v: urls.crawl_form(F.concat(F.lit(base), v))))
    return pages.select("page_id", F.posexplode(found).alias("pos", "url"))


def linked_urls(pages: DataFrame, pattern: str = ".*") -> DataFrame:
    """The same for plain links whose address matches the pattern."""
    links = F.regexp_extract_all("html", F.lit(r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"']*)["']"""), 1)
    wanted = F.filter(F.transform(links, urls.crawl_form), lambda u: u.rlike(pattern))
    return pages.select("page_id", F.posexplode(F.array_distinct(wanted)).alias("pos", "url"))


# -------------------------------------------------------------- page state --
def _keyed(keys: list[str], shape: str) -> str:
    return rf'"(?:{"|".join(keys)})"\s*:\s*{shape}'


_NUMBERS = _keyed(vocab.STATE_NUMBERS, r"\d+")
_TEXTS = _keyed(vocab.STATE_TEXTS, '"[^"]+"') + "|" + _keyed(["FloorNum"], r'"\d+"?')
_LISTS = _keyed(vocab.STATE_LISTS, r"\[[^\]]*\]")


def has_state(html: Column) -> Column:
    """The state mark stands on the page and some known key follows it."""
    return html.contains(vocab.STATE_MARK) & html.rlike(f"(?s){vocab.STATE_MARK}.*?(?:{_NUMBERS}|{_TEXTS}|{_LISTS})")


def with_state(pages: DataFrame) -> DataFrame:
    """Pages with the values of their state block as one struct `state`.

    The block runs from its mark to the end of the page. One scan of it per
    value shape collects all `"key": value` pieces; the first piece of a key
    counts, and each key is then read from its own short piece.
    """
    html = F.col("html")
    block = F.when(html.contains(vocab.STATE_MARK), F.substr(html, F.locate(vocab.STATE_MARK, html)))
    shapes = {"_numbers": _NUMBERS, "_texts": _TEXTS, "_lists": _LISTS}
    # a step of its own, so that the block is cut out once
    pieces = pages.withColumn("_block", block)
    pieces = pieces.withColumns({n: F.regexp_extract_all("_block", F.lit(p), 0) for n, p in shapes.items()}).drop("_block")
    pieces = pieces.withColumns(
        {f"{n}_keys": F.transform(n, lambda p: F.substring_index(F.substring(p, 2, 99), '"', 1)) for n in shapes}
    )

    def first(shape: str, key: str) -> Column:
        piece = F.get(shape, F.array_position(f"{shape}_keys", key).cast("int") - 1)
        # the shapes see to it that a value starts with a digit, a quote or a bracket
        return F.ltrim(F.substring(piece, len(key) + 3, 1 << 30), F.lit(" \t\n\x0b\x0c\r:"))

    def unquoted(value: Column) -> Column:
        return F.btrim(value, F.lit('"'))  # there is no quote in a value

    state = {k: first("_numbers", k).try_cast("int") for k in vocab.STATE_NUMBERS}
    state |= {k: unquoted(first("_texts", k)) for k in vocab.STATE_TEXTS}
    state |= {k: first("_lists", k) for k in vocab.STATE_LISTS}
    # a bare number wins over a quoted one
    state["FloorNum"] = F.coalesce(state["FloorNum"], unquoted(first("_texts", "FloorNum")).try_cast("int"))
    state["RoomLayoutImageUrl"] = F.replace(state["RoomLayoutImageUrl"], F.lit("\\/"), F.lit("/"))
    whole = F.struct(*[v.alias(k) for k, v in state.items()])
    some = functools.reduce(lambda a, b: a | b, [F.coalesce(F.size(n) > 0, F.lit(False)) for n in shapes])
    return pieces.withColumn("state", F.when(some, whole)).drop(*shapes, *[f"{n}_keys" for n in shapes])


def _positive(value: Column) -> Column:
    return text.once(value, lambda v: F.when(v > 0, v))


def state_fields() -> dict[str, Column]:
    """Listing columns out of the struct `state`."""
    def s(key: str) -> Column:
        return F.col(f"state.{key}")

    def decoded(key: str) -> Column:
        return text.unescape_json(s(key))

    return {
        "rent": _positive(s("Price")),
        "area": (_positive(s("MonopolyArea")) / 100).cast("decimal(10,2)"),
        "walk_time": _positive(s("MinutesFromStation")),
        "floor": s("FloorNum"),
        "building_age": s("YearsOld"),
        "building_name": decoded("BuildingName"),
        "address": decoded("AddressName"),
        "station": decoded("StationName"),
        "direction": decoded("Direction"),
        "structure": decoded("StructureName"),
        "floor_plan_details": decoded("RoomLayoutBreakdown"),
        "floor_plan": attributes.floor_plan(decoded("RoomLayoutBreakdown")),
        "building_type": F.when(
            s("KindName").isNotNull(), attributes.building_type(decoded("KindName"), decoded("StructureName"))
        ),
        "floor_label": decoded("FloorNameLabel"),
        "parking": decoded("ParkingAreaLabel"),
        "contract_period": decoded("ContractPeriod"),
        "insurance": decoded("Insurance"),
        "room_layout_image_url": s("RoomLayoutImageUrl"),
        "facilities": attributes.facility_keys(F.from_json(s("Facilities"), "array<string>")),
        "features": F.from_json(s("Pickouts"), "array<string>"),
    }


def text_fields(page_text: Column) -> dict[str, Column]:
    """Listing columns read from the page text, for pages without state."""
    return {
        "rent": text.rent(page_text),
        "floor_plan": text.floor_plan(page_text),
        "area": text.area(page_text).cast("decimal(10,2)"),
        "walk_time": text.walk_minutes(page_text),
        "station": text.station(page_text),
        "address": text.address(page_text),
        "building_age": _positive(text.building_age(page_text)),
        "floor": _positive(text.floor(page_text)),
    }


# -------------------------------------------------------- stations, images --
# --- fixed values: access line patterns ------------------------------------
ACCESS_WALK = r"徒歩\s*([0-9]+)\s*分"
ACCESS_LINE = r"^(.+?)\s*(?:徒歩|バス|車)"
ACCESS_RANGE = (1, 120)


def page_access(html: Column) -> Column:
    """Array of (station_name, line_name, walk_minutes, sort_order), one per access
    item with a station name. Minutes are 0 for bus and other access."""
    items = F.regexp_extract_all(
        html, F.lit(rf"(?is)<li\b[^>]*\b{vocab.ACCESS_CLASS}\b[^>]*>(.*?)</li\s*>"), 1
    )
    anchor = rf"(?is)<a\b[^>]*\b{vocab.STATION_CLASS}\b[^>]*>(.*?)</a\s*>"

    # one transform per step, so that no step repeats the work of an earlier one
    def read(item: Column) -> Column:
        name = F.try_element_at(F.regexp_extract_all(item, F.lit(anchor), 1), F.lit(-1))
        line = text.squeeze(text.strip(text.visible_text(item)))
        return F.struct(text.strip(text.visible_text(name)).alias("name"), line.alias("line"))

    def without_name(item: Column) -> Column:
        name, line = item["name"], item["line"]
        at = F.instr(line, name)
        rest = F.concat(F.left(line, at - 1), F.substr(line, at + F.length(name)))
        rest = text.strip(F.when(at == 0, line).otherwise(rest))
        return F.struct(name.alias("name"), text.strip(F.regexp_replace(rest, "^/", "")).alias("rest"))

    def parts(item: Column, position: Column) -> Column:
        rest = item["rest"]
        minutes = text.once(F.regexp_extract(rest, ACCESS_WALK, 1).try_cast("int"),
                            lambda m: F.when(m.between(*ACCESS_RANGE), m))
        carrier = text.once(F.regexp_extract(rest, ACCESS_LINE, 1), text.blank_to_null)
        return F.struct(
            item["name"].alias("station_name"),
            F.regexp_replace(F.coalesce(carrier, rest), "^[/ 　]+|[/ 　]+$", "").alias("line_name"),
            F.coalesce(minutes, F.lit(0)).alias("walk_minutes"),
            (position + 1).alias("sort_order"),
        )

    named = F.filter(F.transform(items, read), lambda i: F.coalesce(i["name"], F.lit("")) != "")
    return F.transform(F.transform(named, without_name), parts)


def access_rows(pages: DataFrame) -> DataFrame:
    """(page_id, station_name, line_name, walk_minutes, sort_order)."""
    return pages.select("page_id", F.inline(page_access(F.col("html"))))


def with_first_station(rows: DataFrame, access: str = "access") -> DataFrame:
    """The first station names the listing; its minutes count only when it is walkable."""
    first = F.get(access, 0)
    return rows.withColumns(
        {
            "station": F.coalesce(first["station_name"], "station"),
            "walk_time": F.coalesce(_positive(first["walk_minutes"]), "walk_time"),
        }
    )


# --- fixed values: part of an image URL that names the picture -------------
SIGNATURE_START, SIGNATURE_END = 140, 240


def image_signature(url: Column) -> Column:
    """The part of an address that names the picture, whatever its scaling."""
    size = SIGNATURE_END - SIGNATURE_START
    middle = F.substring(url, SIGNATURE_START + 1, size)
    return F.when(F.length(url) > SIGNATURE_START, middle).otherwise(url)


def distinct_images(found: Column, limit: int | None = None, by_signature: bool = False) -> Column:
    """Different URLs in page order, all of them unless a limit is given.

    by_signature takes the first URL of each picture only, told by a part of the address.
    """
    if by_signature:
        # neighbours in the order of (signature, place): the first of each signature stays
        entries = F.sort_array(F.transform(found, lambda url, i: F.struct(
            image_signature(url).alias("signature"), i.alias("place"), url.alias("url"))))
        before = F.concat(F.array(F.lit(None).cast("struct<signature:string,place:int,url:string>")), entries)
        pairs = F.filter(F.arrays_zip(entries.alias("own"), before.alias("before")),
                         lambda p: p["own"].isNotNull() & ~p["own"]["signature"].eqNullSafe(p["before"]["signature"]))
        kept = F.sort_array(F.transform(pairs, lambda p: F.struct(p["own"]["place"].alias("place"), p["own"]["url"].alias("url"))))
        found = F.transform(kept, lambda p: p["url"])
    else:
        found = F.array_distinct(found)
    return found if limit is None else F.slice(found, 1, limit)


def page_images(html: Column) -> Column:
    """Image URLs: by address pattern, then two state fields, then og:image."""
    def unslashed(urls_: Column) -> Column:
        return F.transform(urls_, lambda u: F.replace(u, F.lit("\\/"), F.lit("/")))

    def non_empty(urls_: Column) -> Column:
        return F.nullif(urls_, F.array().cast("array<string>"))

    by_address = F.regexp_extract_all(html, F.lit(vocab.IMAGE_URL_PATTERN), 0)
    resized = F.regexp_substr(html, F.lit(r'"ResizedExternalImageUrls"\s*:\s*\[[^\]]+\]'))
    resized = F.regexp_extract_all(resized, F.lit(r'"Url"\s*:\s*"([^"]+)"'), 1)
    single = F.regexp_extract(F.regexp_substr(html, F.lit(r'"ExternalImageUrl":"[^"]+"')), ':"(.*)"$', 1)
    og = _filled(_attribute(_tag(html, "meta", "property", "og:image"), "content"))
    return F.coalesce(
        non_empty(distinct_images(by_address)),
        non_empty(F.array_distinct(unslashed(resized))),
        unslashed(F.when(single.isNotNull(), F.array(single))),
        F.when(og.isNotNull(), F.array(og)),
        F.array().cast("array<string>"),
    )


def image_rows(pages: DataFrame) -> DataFrame:
    """(page_id, image_url, sort_order), numbered from 0."""
    return pages.select("page_id", F.posexplode(page_images(F.col("html"))).alias("sort_order", "image_url"))


# --------------------------------------------------------------- amenities --
def category_labels(page_text: Column) -> Column:
    """Labels of lines that start with an amenity category, split at '/'."""
    heads = "|".join(re.escape(c) for c in vocab.FACILITY_CATEGORIES)
    rests = F.regexp_extract_all(page_text, F.lit(rf"(?Umd)^[^\S\n]*(?:{heads})(.*)$"), 1)
    labels = F.transform(F.flatten(F.transform(rests, lambda rest: F.split(rest, "/"))), text.strip)
    return F.array_distinct(F.filter(labels, lambda label: label != ""))


# --- fixed values: elements without an end tag -----------------------------
_VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"]


_PIECE = re.compile(r"<!--.*?-->|<(/?)([A-Za-z][A-Za-z0-9]*)[^>]*?(/?)>", re.S)


def first_element(after: str | None) -> str | None:
    """The first element that starts in the text, up to its end tag. Closing tags before it are passed over.

    One pass over the tags with the depth of open elements; a text without the end tag is taken to its end.
    """
    start, depth = None, 0
    for piece in _PIECE.finditer(after or ""):
        closing, name, void = piece.groups()
        if name is None or void or name.lower() in _VOID:
            continue
        if closing:
            if start is None:
                continue
            depth -= 1
            if depth == 0:
                return after[start:piece.end()]
        else:
            start = piece.start() if start is None else start
            depth += 1
    return None if start is None else after[start:]


def _first_elements(after: Column) -> Column:
    # nesting is no regular language, and a fold over an array of tags is interpreted row by row
    @F.pandas_udf("string")
    def elements(texts: pd.Series) -> pd.Series:
        return texts.map(first_element)

    return elements(after)


def page_section_labels(html: Column, longest: int | None = None) -> Column:
    """Array of labels of the amenity section, NULL on pages without its heading.

    The section is the element that follows the heading. Icons count by their text unless the element
    around them is disabled; then come short texts that hint at an amenity, of any length unless
    `longest` bytes are given.
    """
    heading = re.escape(vocab.AMENITY_HEADING)
    after = F.regexp_extract(html, rf"(?is)<([a-z][a-z0-9]*+)\b[^>]*+>\s*{heading}\s*</\1\s*>(.*)$", 2)
    scope = F.coalesce(_first_elements(after), F.lit(""))
    icons = F.regexp_extract_all(scope, F.lit(r"(?is)(?:<[a-z][^>]*>\s*)?<img\b[^>]*>"), 0)
    shown = F.filter(icons, lambda i: ~F.regexp_extract(i, r"(?is)^(<(?!img)[^>]*>)?", 1).contains(vocab.AMENITY_DISABLED))
    alts = F.transform(shown, lambda i: text.unescape_html(text.strip(
        F.coalesce(_attribute(F.regexp_extract(i, r"(?is)(<img\b[^>]*>)$", 1), "alt"), F.lit("")))))
    texts = F.transform(F.regexp_extract_all(scope, F.lit(r"(?is)<(?:li|span|div)\b[^>]*>([^<]+)</(?:li|span|div)\s*>"), 1),
                        lambda t: text.strip(text.unescape_html(t)))
    hints = "|".join(re.escape(h) for h in vocab.AMENITY_HINTS)
    short = F.filter(texts, lambda t: t.rlike(hints) & (F.octet_length(t) < longest if longest else F.lit(True)))
    labels = F.array_distinct(F.filter(F.concat(alts, short), lambda label: label != ""))
    return F.when(html.contains(vocab.AMENITY_HEADING), labels)


def section_labels(pages: DataFrame) -> DataFrame:
    """(page_id, labels) for pages with the amenity heading."""
    labelled = pages.select("page_id", page_section_labels(F.col("html")).alias("labels"))
    return labelled.filter(F.col("labels").isNotNull())
