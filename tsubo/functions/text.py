"""Text cleaning and values read from free text. No match gives NULL."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsubo import vocab

# --- fixed values: patterns of values in page text -------------------------
RENT_IN_MAN = r"([0-9]+\.?[0-9]*)万円"
RENT_IN_YEN = r"賃料[：:]\s*([0-9,]+)円"
FLOOR_PLAN = r"([0-9]?[SLDK]+)(?![0-9A-Za-z_])"
AREA = r"([0-9]+\.?[0-9]*)[㎡m²]"
WALK = r"[徒歩]+([0-9]+)分"
BUILDING_AGE = r"築[年数]*([0-9]+)年"
FLOOR = r"([0-9]+)[階F]"
STATION = r"([^\s]+駅)\s*[徒歩]"
ADDRESS = "(?:" + "|".join(vocab.PREFECTURES) + r")[^\n]+"
# every character that the class \s takes in with Unicode
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
RENT_RANGE = (10000, 10000000)
AREA_RANGE = (5.0, 500.0)
WALK_RANGE = (1, 60)
AGE_RANGE = (0, 100)
FLOOR_RANGE = (0, 100)


def strip(text: Column) -> Column:
    """Trim every kind of white space, the full-width one too."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def squeeze(text: Column) -> Column:
    """Full-width spaces become plain ones and runs become one."""
    return F.regexp_replace(text, r"(?U)\s+", " ")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed one time per row however often it is used.

    In branches of a condition Spark computes a repeated expression again each time.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _within(value: Column, bounds: tuple) -> Column:
    return once(value, lambda v: F.when(v.between(*bounds), v))


def _captured(text: Column, pattern: str, kind: str) -> Column:
    return F.regexp_extract(text, pattern, 1).try_cast(kind)


# ---------------------------------------------------------------- titles ----
def _without_brands(text: Column, left: str = "", right: str = "") -> Column:
    marks = "|".join(re.escape(left + b + right) for b in vocab.BRANDS)
    return F.regexp_replace(text, marks, "")


def clean_title(title: Column) -> Column:
    """Drop brand words and what follows a separator, then edge marks."""
    def cut(text: Column, separator: str) -> Column:
        sep = re.escape(separator)
        return F.regexp_replace(text, rf"(?s)^(?!{sep})(.+?){sep}.*$", "$1")

    kept = functools.reduce(cut, vocab.TITLE_SEPARATORS, _without_brands(strip(title)))
    edge = "[" + re.escape(vocab.TITLE_TRIM) + "]"
    return strip(F.regexp_replace(strip(kept), rf"^{edge}+|{edge}+$", ""))


def clean_title_in_table(title: Column) -> Column:
    """Variant for rows already stored: bracketed brands go first, a separator at
    the very start cuts too, empty brackets and double spaces vanish."""
    def cut(text: Column, separator: str) -> Column:
        return F.regexp_replace(text, rf"(?s)^ *(.*?) *{re.escape(separator)}.*$", "$1")

    text = _without_brands(_without_brands(title, "【", "】"))
    text = functools.reduce(cut, vocab.TITLE_SEPARATORS, text)
    text = F.regexp_replace(F.regexp_replace(text, "【】", ""), "【 】", "")
    text = F.trim(F.replace(text, F.lit("  "), F.lit(" ")))
    for mark in "-|｜【】":
        text = F.btrim(text, F.lit(mark))
    return F.trim(F.replace(F.trim(text), F.lit("  "), F.lit(" ")))


def is_dirty_title(title: Column) -> Column:
    return functools.reduce(lambda a, b: a | b, [title.contains(m) for m in vocab.DIRTY_TITLE_MARKS])


# ------------------------------------------------------- values from text ---
def rent(text: Column) -> Column:
    in_man = (_captured(text, RENT_IN_MAN, "double") * 10000).cast("bigint")
    in_yen = F.regexp_replace(F.regexp_extract(text, RENT_IN_YEN, 1), ",", "").try_cast("bigint")
    return F.coalesce(_within(in_man, RENT_RANGE), _within(in_yen, RENT_RANGE)).cast("int")


def floor_plan(text: Column) -> Column:
    return blank_to_null(F.regexp_extract(text, FLOOR_PLAN, 1))


def area(text: Column) -> Column:
    return _within(_captured(text, AREA, "double"), AREA_RANGE)


def walk_minutes(text: Column) -> Column:
    return _within(_captured(text, WALK, "int"), WALK_RANGE)


def building_age(text: Column) -> Column:
    return _within(_captured(text, BUILDING_AGE, "int"), AGE_RANGE)


def floor(text: Column) -> Column:
    return _within(_captured(text, FLOOR, "int"), FLOOR_RANGE)


def station(text: Column) -> Column:
    return blank_to_null(F.regexp_extract(text, STATION, 1))


def address(text: Column, length: int | None = None) -> Column:
    """From the prefecture to the end of the line; `length` cuts it for a column that holds no more."""
    found = strip(F.regexp_extract(text, ADDRESS, 0))
    return blank_to_null(F.left(found, F.lit(length)) if length else found)


# --------------------------------------------------------------- escapes ----
def unescape_json(text: Column) -> Column:
    r"""Decode \uXXXX and \/ ; text that is no valid JSON string stays as it is."""
    wrapped = F.concat(F.lit('{"v":"'), text, F.lit('"}'))
    decoded = F.coalesce(F.from_json(wrapped, "v string")["v"], text)
    # without a backslash or a quote a text stands for itself
    return F.when(text.contains("\\") | text.contains('"'), decoded).otherwise(text)


# --- fixed values: character references decoded in page text ---------------
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")]


def unescape_html(text: Column) -> Column:
    """Decode the common character references; the ampersand goes last."""
    return functools.reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ENTITIES, text)


def visible_text(html: Column) -> Column:
    """Page text: comments and tags removed, character references decoded."""
    return unescape_html(F.regexp_replace(html, r"(?s)<(?:!--.*?-->|[^>]*+>)", ""))
