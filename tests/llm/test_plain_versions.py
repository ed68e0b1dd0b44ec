"""Operators without SQL against plain versions of their method, and what the models find in planted data."""

import math
import random
import struct

import numpy as np
import pytest
import xxhash

from tests.llm.data import sentence
from tests.llm.test_text_operators import trained
from tsubo.llm import fingerprint, langid, pii, urlfilter


# ------------------------------------------------------------------ URL filter
def plain_groups(nodes, similar):
    """(l, b) of siblings by name -> number of the group."""
    entries: dict = {}
    for l, b in nodes.values():
        kind = "few" if l < urlfilter.LEAST_LABELS else f"{l}/{b}"
        e = entries.setdefault(kind, [0, 0, 0, 0])
        e[0] += l
        e[1] += b
        e[2:] = (e[0], e[1]) if kind == "few" else (l, b)
    total = sum(b for _, b in nodes.values()) / max(1, sum(l for l, _ in nodes.values()))
    order = sorted((b / l if l else total, kind, l, b, n, k) for kind, (l, b, n, k) in entries.items())
    seen_l = seen_b = group = 0
    place = {}
    for _, kind, l, b, n, k in order:
        p = (seen_b + k) / max(seen_l + n, 1)
        room = similar * math.sqrt(p * (1 - p) * (1 / max(seen_l, 1) + 1 / max(n, 1))) + 1e-12
        if seen_l == 0 or n == 0 or abs(k / max(n, 1) - seen_b / max(seen_l, 1)) <= room:
            seen_l, seen_b = seen_l + l, seen_b + b
        else:
            seen_l, seen_b, group = l, b, group + 1
        place[kind] = group
    return {name: place["few" if l < urlfilter.LEAST_LABELS else f"{l}/{b}"] for name, (l, b) in nodes.items()}


def test_siblings_are_cut_as_in_a_plain_version(spark):
    rng = random.Random(4)
    parents = {}
    for up in range(30):
        sizes = [rng.choice([0, 2, 4, 6, 30, 200]) for _ in range(rng.randrange(1, 14))]
        parents[f"/{up}"] = {f"n{i}": (l, round(l * rng.choice([0, 0.1, 0.15, 0.5, 0.9, 1]))) for i, l in enumerate(sizes)}
    rows = [("h", up, True, name, l, b, "few" if l < urlfilter.LEAST_LABELS else f"{l}/{b}")
            for up, nodes in parents.items() for name, (l, b) in nodes.items()]
    df = spark.createDataFrame(rows, "host string, up string, leaf boolean, _node string, l bigint, b bigint, kind string")
    found: dict = {}
    for r in urlfilter._groups(df, urlfilter.SIMILAR).collect():
        found.setdefault(r["up"], {})[r["_node"]] = r["group"]
    assert found == {up: plain_groups(nodes, urlfilter.SIMILAR) for up, nodes in parents.items()}


def test_chains_of_only_children_are_one_round(spark, monkeypatch):
    rounds = []
    keep = urlfilter.stored
    monkeypatch.setattr(urlfilter, "stored", lambda df, label: (rounds.append(label), keep(df, label))[1])
    deep, other = "/a" * 300, "/b" * 300
    paths = [("t", f"{deep}/{i}") for i in range(10)] + [("u", f"/{x}{other}/{x}{i}") for x in "xy" for i in range(2)]
    paths += [("v", "/one/two"), ("v", "/one/two/three"), ("v", "/one"), ("w", "/"), ("w", "")]
    df = spark.createDataFrame([(h, p, i, None) for i, (h, p) in enumerate(paths)], "host string, path string, page_id int, bad int")
    found = {(r["host"], r["path"]): r["template"] for r in urlfilter.template_tree(df).collect()}
    assert len(found) == len(paths)
    assert {t for (h, _), t in found.items() if h == "t"} == {f"{deep}/<num>"}
    assert all(t == p for (h, p), t in found.items() if h in "uv") and found["w", "/"] == found["w", ""] == "/"
    assert rounds.count("url-level") <= 3
    counted = [(h, t, 1, 0, 0) for h, t in {(h, t) for (h, _), t in found.items()}]
    branches = urlfilter.merged_branches(spark.createDataFrame(counted, "host string, template string, pages bigint, labelled bigint, bad bigint")).collect()
    assert len(branches) == len(counted) and rounds.count("url-branches") <= 4
    assert len({r["branch"] for r in branches if r["host"] == "u"}) == 1


# ------------------------------------------------------------------ fingerprints
def plain_signature(text, pieces=fingerprint.PIECES):
    """Order MinHash in plain Python, with the hash that the DataFrame function has."""
    low, seed, top = (1 << fingerprint.PLACE_BITS) - 1, 42, 1 << 64

    def signed(x):
        return x - top if x >> 63 else x

    def number(x, size, seed):
        return xxhash.xxh64_intdigest(struct.pack("<q" if size == 8 else "<i", x), seed=seed)

    cut, at = [], 0  # start and end of each piece
    while at < len(text):
        if text[at] in " \t\n\x0b\x0c\r":
            at += 1
            continue
        end = at
        while end < len(text) and end - at < 8 and text[end] not in " \t\n\x0b\x0c\r":
            end += 1
        cut.append((at, end))
        at = end
    kmers = [(text[cut[i][0]:cut[i + pieces - 1][1]], i) for i in range(len(cut) - pieces + 1)] or ([(text, 0)] if text else [])
    times: dict = {}
    every = []
    for kmer, place in sorted(((xxhash.xxh64_intdigest(k, seed=seed) >> fingerprint.PLACE_BITS, i) for k, i in kmers), key=lambda x: x[1]):
        n = times[kmer] = times.get(kmer, -1) + 1
        if n:
            kmer = number(n - 1, 4, number(kmer, 8, seed)) >> fingerprint.PLACE_BITS
        every.append((kmer, place))
    slots: dict = {}
    for kmer, place in sorted(every):
        slots.setdefault(kmer >> (64 - fingerprint.PLACE_BITS - fingerprint.SLOT_BITS), []).append((place, kmer))
    out = []
    for slot, members in slots.items():
        value = seed
        for _, kmer in sorted(members[:2]):
            value = number(signed(kmer << fingerprint.PLACE_BITS), 8, value)
        out.append(((slot << (32 - fingerprint.SLOT_BITS)) | (value >> (32 + fingerprint.SLOT_BITS))) - (1 << 31))
    return sorted(out)


def test_signatures_are_those_of_a_plain_version(spark):
    rng = random.Random(8)
    texts = ["", " ", "a", "a b", "a b c", "a b c " * 40, "x" * 100, "é" * 9 + " ü  ñ\n日本", "one  two three one  two three", "a" * 17 + " b"]
    texts += [sentence(rng, rng.randrange(1, 400)) for _ in range(30)]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randrange(1, 120))) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in fingerprint.with_signature(df, "text", "s").collect():
        assert sorted(r["s"]) == plain_signature(texts[r["doc_id"]]), texts[r["doc_id"]]


# ------------------------------------------------------------------ personal data
def segmentations(found):
    """Every choice of segments that do not overlap."""
    starts: dict = {}
    for s, (i, _) in enumerate(found.where):
        starts.setdefault(i, []).append(s)

    def walk(i):
        if i >= found.n:
            yield []
            return
        yield from walk(i + 1)
        for s in starts.get(i, []):
            for rest in walk(found.where[s][1]):
                yield [s, *rest]

    return list(walk(0))


def short_runs(n):
    rng, out = random.Random(6), []
    while len(out) < n:
        text = "".join(rng.choice(["12", "345", "6789", "1234567", "-", ".", " ", "(", ")", "+", "@", "a.de"]) for _ in range(rng.randrange(2, 9)))
        found = pii.Segments(text, 0, len(text))
        if 1 <= len(found.where) <= 12:
            out.append(found)
    return out


def test_best_and_marginals_of_enumerated_segmentations():
    numbers = np.random.default_rng(5)
    several = 0
    for found in short_runs(150):
        weights = numbers.normal(size=(pii.N_FEATURES, len(pii.KINDS)))
        scores = found.features @ weights
        every = segmentations(found)
        several += max(map(len, every)) > 1
        gains = [sum(scores[s].max() - pii.LEAST_ODDS for s in chosen) for chosen in every]
        spans = {(found.cuts[i], found.cuts[j]): s for s, (i, j) in enumerate(found.where)}
        best = found.best(weights)
        assert all(pii.KINDS.index(kind) == scores[spans[a, b]].argmax() for kind, a, b in best)
        assert [b for _, _, b in best[:-1]] <= [a for _, a, _ in best[1:]]
        assert sum(scores[spans[a, b]].max() - pii.LEAST_ODDS for _, a, b in best) == pytest.approx(max(gains), abs=1e-9)
        odds = np.exp(scores).sum(axis=1)
        share = [math.prod(odds[s] for s in chosen) for chosen in every]
        plain = np.array([sum(x for x, chosen in zip(share, every) if s in chosen) for s in range(len(found.where))]) / sum(share)
        np.testing.assert_allclose(found.expectations(weights), plain[:, None] * np.exp(scores) / odds[:, None], rtol=1e-9)
    assert several > 10


def planted(n):
    """(text, personal spans in formats that the patterns miss): each beside numbers that are not personal."""
    rng, out = random.Random(12), []
    d = lambda k: "".join(str(rng.randrange(10)) for _ in range(k))
    for i in range(n):
        head = "4" + d(14)
        card = next(head + str(c) for c in range(10) if pii.luhn(head + str(c)))
        groups = [card[k:k + 4] for k in range(0, 16, 4)]
        kind, form = [("phone", f"{rng.randrange(200, 999)}-{d(3)}-{d(4)}"), ("phone", f"({rng.randrange(200, 999)}) {d(3)}-{d(4)}"),
                      ("phone", f"{rng.randrange(200, 999)}.{d(3)}.{d(4)}"), ("card", ".".join(groups)), ("card", "/".join(groups)),
                      ("card", "_".join(groups)), ("email", f"jörg{i}@büro{i}.example.com"), ("email", f"ann{i}@exämple.org")][i % 8]
        other = [f"{rng.randrange(1950, 2040)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", f"{rng.randrange(10**6)}.{d(2)}",
                 f"{rng.randrange(1, 29):02d}.{rng.randrange(1, 13):02d}.{rng.randrange(1950, 2040)}", f"{rng.randrange(10**8)}"][i // 8 % 4]
        out.append((f"ask for {form} or wait; they wrote {other} there", (kind, 8, 8 + len(form))))
    return out


def test_recall_and_precision_of_added_spans():
    weights, hits, added, truth = trained(), 0, 0, planted(400)
    missed: dict = {}
    for text, span in truth:
        base, every = pii.spans_of(text, weights)
        more = [s for s in every if s not in base]
        added += len(more)
        hits += span in more
        if span not in more:
            missed[span[0]] = missed.get(span[0], 0) + 1
    print("recall", hits / len(truth), "precision", hits / added, "missed", missed)
    assert hits >= 0.9 * len(truth) and hits >= 0.9 * added


# ------------------------------------------------------------------ language
def plain_language(model, text):
    total, n = np.zeros(len(model["languages"])), 0
    for chunk in text.split():
        word = chunk.strip(langid.EDGES).lower()
        if not any(c.isalpha() for c in word):
            continue
        n += 1
        if word in model["words"]:
            total += model["words"][word]
            continue
        marked = f"^{word}$"
        for size in range(len(model["grams"]) - 1, 0, -1):
            hits = [model["grams"][size][marked[i:i + size]] for i in range(len(marked) - size + 1) if marked[i:i + size] in model["grams"][size]]
            if hits:
                total += np.mean(hits, axis=0)
                break
    if not n:
        return "und", 0.0
    odds = np.exp((total - total.max()) / math.sqrt(n))
    return model["languages"][int(np.argmax(odds))], odds.max() / odds.sum()


@pytest.mark.parametrize("room", [3, 1000])
def test_scores_are_those_of_a_plain_version(room):
    rng, numbers = random.Random(1), np.random.default_rng(1)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(1, 8))) for _ in range(60)]
    vector = lambda: np.log(numbers.random(3))
    grams = [{}] + [{g: vector() for g in {f"^{w}$"[i:i + size] for w in words[:40] for i in range(len(w) + 3 - size)} if rng.random() < 0.5}
                    for size in range(1, langid.LONGEST + 1)]
    model = {"languages": ["a", "b", "c"], "words": {w: vector() for w in words[:25]}, "grams": grams}
    scorer = langid.Scorer(model, room)
    for _ in range(300):
        text = " ".join(rng.choice([rng.choice(words), rng.choice(words).upper() + ",", "12", "(zzz)", "..."]) for _ in range(rng.randrange(0, 30)))
        lang, score = scorer(text.encode())
        expected = plain_language(model, text)
        assert lang == expected[0] and score == pytest.approx(expected[1], abs=1e-9), text
