"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds spans.

The patterns (e-mail, IP address, card and phone numbers) are the base and always stay. Text that looks
like such data but breaks a pattern (other separators, no country code, letters beyond ASCII in a
domain) is left to the model. Such text comes in runs: digits with separators between them, or the
chunk around an @. A run is cut into atoms (digit groups, letter groups, single other characters). Every
segment of up to `LONGEST` atoms is scored as a whole for every kind by features of the whole span
(digits, groups, check sum, separators, neighbours); the dynamic program over segments picks
boundaries and kinds together.

The model is trained on the driver by maximum likelihood on a bounded number of runs (`SAMPLE`), which
the patterns label; copies with another format (no plus sign, other separators) keep their label, so the
model learns the kinds beyond the patterns. Everything else covers every whole text.

Cases: null is the empty text and has no spans. Positions are code points. Overlapping spans of
different kinds all stay. Repeated rows are searched each; an empty table gives no rows, and without
training runs only the patterns are used. Other columns are kept out of the result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LONGEST = 16
SAMPLE = 800
LEAST_ODDS = 2.0  # log odds of the best segmentation against none, from which a span is added
LEAST_DIGITS = 7

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a match starts at the start of its digits: possessive and anchored forms match the same, in linear time
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_RUN = re.compile(r"[+(]{0,2}[0-9][0-9\x20()+./_·–-]*+")
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, by start, then kind."""
    found = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    found.append(("phone", *m.span()))
    found.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return found


# ------------------------------------------------------------------ runs and segments
def runs(text: str) -> list[tuple[int, int]]:
    """Where the model looks: (start, end) of digit runs and of chunks around an @."""
    found = []
    if _DIGIT.search(text):
        for m in _RUN.finditer(text):
            part = m[0].rstrip(" ().+/_·–-")
            if sum(map(str.isdigit, part)) >= LEAST_DIGITS:
                found.append((m.start(), m.start() + len(part) + (m[0][len(part):len(part) + 1] == ")")))
    at, done = text.find("@"), 0
    while at >= 0:
        start, end = at, at + 1
        while start > done and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        found.append((start, end))
        done, at = end, text.find("@", end)
    return sorted(found)


def _features(text: str, start: int, end: int, near: tuple[bool, bool]) -> list[float] | None:
    """Features of a whole span; None for what cannot be an entity."""
    span = text[start:end]
    digits = "".join(c for c in span if "0" <= c <= "9")
    n, at = len(digits), span.count("@")
    if at > 1 or (not at and (n < LEAST_DIGITS or n > 19)):
        return None
    if span[0] in " ./-_·–)" or span[-1] in " ./-_·–(+":
        return None
    groups = re.findall(r"[0-9]+", span)
    letters = any(c.isalpha() for c in span)
    if letters and not at:
        return None
    left, _, right = span.partition("@")
    dots = right.count(".") if at else span.count(".")
    parts_ok = not at and dots == 3 and len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)
    domain = bool(at and left and re.fullmatch(r"[\w-]+(?:\.[\w-]+)+", right) and not any(c in "<>()[]:;,\"'" for c in left))
    first = groups[0] if groups else ""
    last = groups[-1] if groups else ""
    plain = not letters and not at
    return [
        1.0, float(at), float(domain), float(bool(right) and right[-1].isalpha()), float(plain),
        float(plain and 12 <= n <= 19), float(plain and 12 <= n <= 19 and luhn(digits)), float(plain and n in (15, 16)),
        float(plain and 9 <= n <= 15), float(plain and 10 <= n <= 12), float(plain and n < 9),
        float(span[0] == "+"), float("(" in span and ")" in span and span.index("(") < span.index(")")),
        float(span.count("(") != span.count(")")), float(plain and len(groups) == 1), float(plain and 3 <= len(groups) <= 5),
        float(plain and all(len(g) == 4 for g in groups[:-1]) and len(groups) >= 3),
        float(plain and len(last) == 4), float(plain and len(first) <= 3), float(parts_ok), float(plain and dots == 3),
        float(len(set(re.findall(r"[^\w]", span)) - {"+", "(", ")", " "}) > 1), float("  " in span),
        float(plain and any(len(g) > 6 for g in groups) and len(groups) > 1), float(near[0]), float(near[1]),
        float(plain and [len(g) for g in groups[-3:]] == [3, 3, 4] and n <= 13),
    ]


N_FEATURES = 27


class Segments:
    """The candidate segments of a run, with their features."""

    def __init__(self, text: str, start: int, end: int):
        self.cuts = [start + m.start() for m in _ATOM.finditer(text[start:end])] + [end]
        n = len(self.cuts) - 1
        atoms = [text[a:b] for a, b in zip(self.cuts, self.cuts[1:])]
        self.where, rows = [], []
        for i in range(n):
            if atoms[i][0].isspace():
                continue
            for j in range(i + 1, min(n, i + LONGEST) + 1):
                if atoms[j - 1][0].isspace():
                    continue
                a, b = self.cuts[i], self.cuts[j]
                near = (text[a - 1:a].isalnum(), text[b:b + 1].isalnum() or text[b:b + 1] in (".", "-") and text[b + 1:b + 2].isalnum())
                row = _features(text, a, b, near)
                if row is not None:
                    self.where.append((i, j))
                    rows.append(row)
        self.n = n
        self.features = np.array(rows).reshape(-1, N_FEATURES)

    def best(self, weights: np.ndarray, least: float = LEAST_ODDS) -> list[tuple[str, int, int]]:
        """The best segmentation: V(j) = max(V(j-1), max over segments ending at j of V(i) + score - least)."""
        if not self.where:
            return []
        scores = self.features @ weights
        kind = scores.argmax(axis=1)
        value, back = np.zeros(self.n + 1), [None] * (self.n + 1)
        at = 0
        for s in sorted(range(len(self.where)), key=lambda s: self.where[s][1]):
            i, j = self.where[s]
            while at < j:
                at += 1
                value[at], back[at] = value[at - 1], None
            gain = value[i] + scores[s, kind[s]] - least
            if gain > value[j]:
                value[j], back[j] = gain, s
        while at < self.n:
            at += 1
            value[at] = value[at - 1]
        out, j = [], self.n
        while j > 0:
            s = back[j]
            if s is None:
                j -= 1
            else:
                i = self.where[s][0]
                out.append((KINDS[kind[s]], self.cuts[i], self.cuts[j]))
                j = i
        return out[::-1]

    def expectations(self, weights: np.ndarray) -> np.ndarray:
        """Probability of each segment and kind, by the forward and backward sums."""
        scores = self.features @ weights
        total = np.logaddexp.reduce(scores, axis=1)
        by_end: dict[int, list[int]] = {}
        by_start: dict[int, list[int]] = {}
        for s, (i, j) in enumerate(self.where):
            by_end.setdefault(j, []).append(s)
            by_start.setdefault(i, []).append(s)
        forward, backward = np.zeros(self.n + 1), np.zeros(self.n + 1)
        for j in range(1, self.n + 1):
            forward[j] = np.logaddexp.reduce([forward[j - 1], *[forward[self.where[s][0]] + total[s] for s in by_end.get(j, [])]])
        for i in range(self.n - 1, -1, -1):
            backward[i] = np.logaddexp.reduce([backward[i + 1], *[backward[self.where[s][1]] + total[s] for s in by_start.get(i, [])]])
        ends = np.array(self.where).reshape(-1, 2)
        return np.exp(scores + (forward[ends[:, 0]] + backward[ends[:, 1]] - forward[-1])[:, None])


# ------------------------------------------------------------------ training
def _other_forms(kind: str, span: str, k: int) -> str:
    """The same datum in a format that the patterns miss."""
    digits = re.sub(r"\D", "", span)
    if kind == "phone":
        forms = [span.removeprefix("+"), span.split(" ", 1)[-1], f"{digits[-10:-7]}-{digits[-7:-4]}-{digits[-4:]}",
                 f"{digits[-10:-7]}.{digits[-7:-4]}.{digits[-4:]}", f"({digits[-10:-7]}) {digits[-7:-4]}-{digits[-4:]}", span.replace("-", "/")]
    elif kind == "card":
        groups = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        forms = [".".join(groups), "/".join(groups), "_".join(groups), "  ".join(groups)]
    elif kind == "email":
        forms = [span.replace("@", "@ü", 1), span[:-3] + "é" + span[-3:]]
    else:
        forms = [span]
    return forms[k % len(forms)]


def training_runs(samples: list[str]) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """(text, gold spans): runs as they are, runs in other formats, and runs that are no personal data."""
    out, seen = [], dict.fromkeys(KINDS, 0)
    for sample in samples:
        gold = base_spans(sample)
        clean = [g for i, g in enumerate(gold) if i == 0 or g[1] >= gold[i - 1][2]]
        out.append((sample, clean))
        for kind, a, b in clean:
            form = _other_forms(kind, sample[a:b], seen[kind])
            seen[kind] += 1
            out.append((f"x {form} x", [(kind, 2, 2 + len(form))]))
    numbers = np.random.default_rng(7).integers(0, 10**9, 200)
    for k, x in enumerate(numbers.tolist()):
        # dates, times, amounts, versions, ranges and plain numbers are not personal
        year, month, day = 1950 + x % 90, x % 12 + 1, x % 28 + 1
        forms = [f"{year}-{month:02d}-{day:02d}", f"{day:02d}.{month:02d}.{year}", f"{year}-{year + 5}", f"{x}", f"{x}.{x % 100:02d}",
                 f"{year}{month:02d}{day:02d}", f"{x}{x % 9973:04d}", f"{x % 50}.{x % 13}.{x % 1000}", f"{x % 9999:04d} {x % 777:04d} {x % 55}", f"{x}{x * 7 % 10**9:09d}"]
        out.append((f"x {forms[k % len(forms)]} x", []))
    return out


def fit(samples: list[str], rounds: int = 80, rate: float = 0.5, penalty: float = 0.001) -> np.ndarray | None:
    """Weights (features x kinds) by gradient ascent on the likelihood of the gold segmentations."""
    if not samples:
        return None
    cases = []
    for text, gold in training_runs(samples):
        for start, end in runs(text):
            found = Segments(text, start, end)
            if not found.where:
                continue
            target = np.zeros((len(found.where), len(KINDS)))
            spans = {(a, b): k for k, a, b in gold}
            for s, (i, j) in enumerate(found.where):
                kind = spans.get((found.cuts[i], found.cuts[j]))
                if kind:
                    target[s, KINDS.index(kind)] = 1
            if len(found.where) <= 400:  # long runs of the sample would only slow the fit down
                cases.append((found, target))
    weights, speed = np.zeros((N_FEATURES, len(KINDS))), np.full((N_FEATURES, len(KINDS)), 1e-8)
    for _ in range(rounds if cases else 0):
        slope = -penalty * len(cases) * weights
        for found, target in cases:
            slope += found.features.T @ (target - found.expectations(weights))
        speed += slope**2
        weights = weights + rate * slope / np.sqrt(speed)
    return weights


def fitted(docs: DataFrame, sample: int = SAMPLE) -> np.ndarray | None:
    """Trains on at most `sample` runs, of documents chosen by a hash of their id."""
    def cut(batches):
        for batch in batches:
            found, keys = [], []
            for pick, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b in runs(text):
                    if b - a <= 200:
                        found.append(text[max(a - 2, 0):b + 2])
                        keys.append(pick)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(found, pa.string())], names=["pick", "run"])

    n = docs.count()
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(max(1, n // (4 * sample)))) == 0)
    rows = some.select(F.xxhash64("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(cut, "pick bigint, run string")
    return fit([r["run"] for r in rows.orderBy("pick", "run").limit(sample).collect()])


# ------------------------------------------------------------------ use
def added_spans(text: str, base: list[tuple[str, int, int]], weights: np.ndarray) -> list[tuple[str, int, int]]:
    """What the model finds outside the base spans."""
    out = []
    covered = sorted((a, b) for _, a, b in base)
    for start, end in runs(text):
        pieces, at = [], start
        for a, b in covered:
            if b <= start or a >= end:
                continue
            pieces.append((at, a))
            at = max(at, b)
        pieces.append((at, end))
        for a, b in pieces:
            part = text[a:b]
            if b - a >= LEAST_DIGITS and ("@" in part or sum(map(str.isdigit, part)) >= LEAST_DIGITS):
                out += Segments(text, a, b).best(weights)
    return out


def spans_of(text: str, weights: np.ndarray | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by start, then kind."""
    base = base_spans(text)
    if weights is None:
        return base, base
    more = added_spans(text, base, weights)
    return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0]))) if more else base


def _joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at, last = [], 0, 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[at:a], f"<{kind}>"]
        at = last = max(last, b)
    return "".join([*out, text[at:]]) if out else text


def find(docs: DataFrame, weights: np.ndarray | None, keep: tuple[str, ...] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """The columns to keep with n_email, n_ip, n_card, n_phone, base_sha256, spans and, if asked for, the redacted text.

    The counts and the hash are of the base spans, `spans` and the redacted text of all.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)  # one small matrix
    names = [*[f"n_{k}" for k in KINDS], "base_sha256", "spans", *(["redacted"] if with_text else [])]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("_text").to_pylist():
                base, every = spans_of(text, shared.value)
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every),
                             *([redacted(text, every)] if with_text else [])))
            columns = list(zip(*rows)) if rows else [[] for _ in names]
            kinds = [*[pa.int64()] * len(KINDS), *[pa.string()] * (len(names) - len(KINDS))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array(c, t) for c, t in zip(columns, kinds)]],
                                             names=[*keep, *names])

    rows = docs.select(*keep, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(run, f"{kinds}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string"
                           + (", redacted string" if with_text else ""))
