"""Normal forms and labels of listing attributes."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsubo import vocab
from tsubo.functions.text import once, strip


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])


def _first_contained(text: Column, rules: list[tuple[str, str]], otherwise: Column | None) -> Column:
    """CASE over 'contains' tests in the order of the rules."""
    case = functools.reduce(
        lambda c, rule: c.when(text.contains(rule[0]), F.lit(rule[1])),
        rules[1:],
        F.when(text.contains(rules[0][0]), F.lit(rules[0][1])),
    )
    return case if otherwise is None else case.otherwise(otherwise)


def floor_plan(text: Column) -> Column:
    """Standard codes pass; otherwise the first listed code contained; else the text."""
    rules = [(vocab.ONE_ROOM, vocab.FLOOR_PLANS[0])] + [(p, p) for p in vocab.FLOOR_PLANS]
    return once(text, lambda text: F.when(text.rlike("^[0-9]?[SLDK]+$"), text).otherwise(
        once(strip(text), lambda trimmed: _first_contained(trimmed, rules, trimmed))))


def building_type(label: Column, structure: Column) -> Column:
    """Structure decides first, then the label; other labels pass in lower case."""
    def by_structure(structure: Column) -> Column:
        steel = F.when(structure.contains(vocab.STEEL) & ~structure.contains(vocab.REINFORCED), F.lit("apartment"))
        return F.coalesce(_first_contained(structure, vocab.STRUCTURE_TYPES, None), steel)

    def by_label(label: Column) -> Column:
        return F.coalesce(_first_contained(label, vocab.BUILDING_LABELS, None), F.lower(label))

    return F.coalesce(
        once(strip(F.coalesce(structure, F.lit(""))), by_structure),
        once(strip(F.coalesce(label, F.lit(""))), by_label),
    )


# ------------------------------------------------------------- amenities ----
def facility_keys(codes: Column) -> Column:
    """Array of codes -> sorted distinct keys; unknown codes vanish."""
    table = _lookup(vocab.FACILITY_CODES)
    known = F.filter(F.transform(codes, lambda c: F.try_element_at(table, c)), lambda k: k.isNotNull())
    return F.array_sort(F.array_distinct(known))


def facility_codes_text(text: Column) -> Column:
    """JSON text of codes -> JSON text of keys. Unreadable text stays, no key gives ''."""
    codes = F.from_json(text, "array<string>")
    keys = facility_keys(codes)
    return F.when(codes.isNull(), text).when(F.size(keys) == 0, F.lit("")).otherwise(F.to_json(keys))


def _trimmed_label_key(label: Column) -> Column:
    by_length = sorted(vocab.FACILITY_LABELS, key=lambda k: (-len(k), k))
    partial = _first_contained(label, [(k, vocab.FACILITY_LABELS[k]) for k in by_length], None)
    return F.coalesce(F.try_element_at(_lookup(vocab.FACILITY_LABELS), label), partial)


def label_keys(labels: Column) -> Column:
    """Array of page labels -> sorted distinct keys. An exact label counts first,
    else the longest known label contained in it."""
    # trimmed in a step of its own, since every test below reads the label
    known = F.transform(F.transform(labels, strip), _trimmed_label_key)
    return F.array_sort(F.array_distinct(F.filter(known, lambda k: k.isNotNull())))


def merge_keys(*arrays: Column) -> Column:
    """Sorted union without empty strings."""
    empty = F.array().cast("array<string>")
    whole = functools.reduce(F.array_union, [F.coalesce(a, empty) for a in arrays])
    return F.array_sort(F.filter(F.array_distinct(whole), lambda k: k != ""))


def facility_list(text: Column) -> Column:
    """Stored amenities as an array: a JSON array, else ' / ' separated text."""
    return F.coalesce(F.from_json(text, "array<string>"), F.split(text, " / "))


def facility_name(key: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(vocab.FACILITY_NAMES), key), key)


def has_all(keys: Column, wanted: list[str]) -> Column:
    return functools.reduce(lambda a, b: a & b, [F.array_contains(keys, w) for w in wanted])


# ---------------------------------------------------------------- labels ----
def rent_label(rent: Column) -> Column:
    """Rent in units of 10,000 yen with one decimal, half up; NULL for 0 or none."""
    tenths = F.floor((rent.cast("bigint") + 500) / 1000)
    text = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"))
    return F.when(rent != 0, text)


def change_label(change_type: Column) -> Column:
    return F.coalesce(F.try_element_at(_lookup(vocab.CHANGE_LABELS), change_type), change_type)


def _elapsed(start: Column, end: Column, seconds: int) -> Column:
    micros = F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
    return F.floor(micros / (seconds * 1_000_000))


def age_label(ts: Column, as_of: Column) -> Column:
    """Largest whole unit since ts: days, hours, minutes, or now."""
    def at_least_one(seconds: int, suffix: str) -> Column:
        n = _elapsed(ts, as_of, seconds)
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(suffix)))

    return F.coalesce(
        at_least_one(86400, "日前"), at_least_one(3600, "時間前"), at_least_one(60, "分前"), F.lit("今")
    )


def days_since_seen(last_seen: Column, as_of: Column) -> Column:
    return F.coalesce(_elapsed(last_seen, as_of, 86400), F.lit(vocab.NEVER_SEEN_DAYS).cast("bigint"))


def is_likely_expired(last_seen: Column, as_of: Column) -> Column:
    return days_since_seen(last_seen, as_of) >= vocab.LIKELY_EXPIRED_DAYS


def is_probably_expired(last_seen: Column, as_of: Column) -> Column:
    return days_since_seen(last_seen, as_of) >= vocab.PROBABLY_EXPIRED_DAYS


def retry_delay_seconds(attempts: Column) -> Column:
    """Delay after `attempts` earlier tries; the last step repeats."""
    steps = F.array(*[F.lit(s) for s in vocab.RETRY_DELAY_SECONDS])
    return F.element_at(steps, F.least(attempts + 1, F.lit(len(vocab.RETRY_DELAY_SECONDS))).cast("int"))


def plus_seconds(ts: Column, seconds: Column | int) -> Column:
    seconds = F.lit(seconds) if isinstance(seconds, int) else seconds
    return ts + F.make_dt_interval(secs=seconds.cast("decimal(18,6)"))
