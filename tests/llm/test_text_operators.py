"""Operators on documents, against brute force on small hard inputs."""

import gc
import hashlib
import pickle
import random
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from tests.llm.data import DOC, documents, jaccard_groups, sentence, shingle_set, substring_cuts
from tsubo.llm import fingerprint, langid, mixing, ngrams, packing, pii, substrings
from tsubo.llm.common import words_of
from tsubo.llm.common import components, stored
from tsubo.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return stored(spark.createDataFrame(rows, DOC).repartition(3), "test-docs")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOC)


def by_id(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


# ------------------------------------------------------------------ components
def test_components_of_chains_stars_and_cycles(spark):
    links = [(i, i + 1) for i in range(50)] + [(100, 100 + i) for i in range(1, 60)] + [(200, 201), (201, 202), (202, 200), (300, 300), (None, 5)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a bigint, b bigint").repartition(7), "test").collect()}
    assert found == {**dict.fromkeys(range(51), 0), **dict.fromkeys(range(100, 160), 100), **dict.fromkeys((200, 201, 202), 200)}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint"), "test").collect() == []


# ------------------------------------------------------------------ n-gram join
@pytest.mark.parametrize(("width", "percent", "block"), [(3, 90, 256), (5, 80, 4)])
def test_join_against_brute_force(docs, rows, width, percent, block):
    expected = jaccard_groups([r[:2] for r in rows], width, percent)
    assert by_id(ngrams.similar_documents(docs, width, percent, block), "n_shingles", "component_id") == expected
    assert len({c for _, c in expected.values()}) < len(rows) - 30  # there is something to find


def test_join_of_nothing_nulls_and_repeats(spark, nothing):
    assert ngrams.similar_documents(nothing).collect() == []
    df = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, "A B C D"), (9, None)], "doc_id bigint, text string")
    found = sorted(map(tuple, ngrams.similar_documents(df).collect()), key=repr)
    assert found == sorted([(None, 2, None), (5, 2, 5), (5, 2, 5), (7, 2, 5), (9, 0, 9)], key=repr)


def test_join_links_chains_that_no_centre_links(spark):
    """Each text differs from the next by two words; the ends are far apart but in one component."""
    rng = random.Random(1)
    words, data = sentence(rng, 200).split(), []
    for i in range(30):
        words[i * 6] = f"n{i}"
        data.append((i, " ".join(words)))
    found = by_id(ngrams.similar_documents(spark.createDataFrame(data, "doc_id bigint, text string"), 3, 90, 8), "component_id")
    assert set(found.values()) == {(0,)}


def test_a_group_of_near_copies_is_linked_without_its_pairs(spark):
    """Copies of one text with one new word each: as many first pairs as members, and no later ones."""
    words = [f"w{i}" for i in range(200)]
    data = [(0, " ".join(words))] + [(i, " ".join([*words[:i], f"n{i}", *words[i + 1:]])) for i in range(1, 150)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    sets = stored(ngrams.document_sets(df, ngrams.rarity(df)), "t").withColumnRenamed("doc_id", "rep")
    posts = stored(ngrams.postings(sets), "t")
    stars = ngrams.star_pairs(posts, 90)
    assert stars.count() < 5 * len(data)
    parts = components(stars, "t")
    assert ngrams.remaining_pairs(posts, parts, 90).count() == 0


@pytest.mark.parametrize("block", [4, 256])
def test_every_link_is_counted(docs, rows, block):
    sets = {r[0]: shingle_set(r[1], 3) for r in rows}
    groups = jaccard_groups([r[:2] for r in rows], 3, 90)
    expected = {d: (sum(d != e and bool(x) and 100 * len(x & y) >= 90 * len(x | y) for e, y in sets.items()), groups[d][1]) for d, x in sets.items()}
    assert by_id(ngrams.linked_documents(docs, 3, 90, block), "n_links", "component_id") == expected
    assert max(n for n, _ in expected.values()) > 3


def test_phrases_in_common_by_chance_write_no_texts_and_single_sets_no_copies(spark, monkeypatch):
    """Long unlike texts share a phrase each; short ones share it with long ones; one has a copy, one a near copy."""
    rng = random.Random(5)
    long = [[f"a{i}x{j}" for j in range(1500 + i)] for i in range(12)]
    for i, words in enumerate(long):
        for other in long[:i]:
            at = rng.randrange(0, 1400)
            words[at:at + 3] = other[at:at + 3]
    data = [(i, " ".join(words)) for i, words in enumerate(long)] + [(100 + i, f"{' '.join(words[5:9])} s{i}") for i, words in enumerate(long)]
    data += [(50, data[3][1]), (51, data[4][1].replace("a4x700", "other"))]
    written, store = {}, ngrams.stored

    def counted(df, label):
        out = store(df, label)
        written.setdefault(label, []).append((out.columns, out.count()))
        return out

    monkeypatch.setattr(ngrams, "stored", counted)
    found = by_id(ngrams.similar_documents(spark.createDataFrame(data, "doc_id bigint, text string")), "n_shingles", "component_id")
    assert found == jaccard_groups(data, 3, 90)
    assert sum(n for columns, n in written["ngram-texts"] if "text" in columns) == 2
    assert [n for _, n in written["ngram-classes"]] == [1]


def test_an_ngram_of_unlike_sizes_only_has_no_postings(spark):
    data = [(i, " ".join(["one", "same", "phrase", *(f"w{i}x{j}" for j in range(n))])) for i, n in enumerate((3, 5, 9, 20, 40, 80, 160))]
    df, levels = spark.createDataFrame(data, "doc_id bigint, text string"), np.full(1 << ngrams.SKETCH_BITS, 9, np.uint8)
    levels[int(next(ngrams.shingles([b"one same phrase"], 3))[0]) & ((1 << ngrams.SKETCH_BITS) - 1)] = 0  # the rarest stands first
    for percent, n in ((90, 0), (30, len(data))):
        classes = stored(ngrams.document_sets(df, levels, 3, percent).withColumnRenamed("doc_id", "rep"), "t")
        assert ngrams.postings(classes, percent).count() == n


def test_prefixes_tell_unlike_texts_apart_and_lose_no_similar_ones(spark):
    rng = random.Random(9)
    texts = [[f"a{i}x{j}" for j in range(1000)] for i in range(2)]
    texts[1][:60] = texts[0][:60]
    for i, n in enumerate((1, 5, 15, 17, 18, 30)):
        words = list(texts[0])
        for at in rng.sample(range(0, 1000, 3), n):
            words[at] = f"b{i}x{at}"
        texts.append(words)
    data = [(i, " ".join(words)) for i, words in enumerate(texts)]
    sets = ngrams.document_sets(spark.createDataFrame(data, "doc_id bigint, text string"), np.zeros(1 << ngrams.SKETCH_BITS, np.uint8))
    classes = stored(sets.withColumnRenamed("doc_id", "rep"), "t")
    pairs = spark.createDataFrame([(a, b) for a in range(len(data)) for b in range(a)], "a bigint, b bigint")
    found = {tuple(r) for r in ngrams.promising(pairs, classes, 90).collect()}
    own = [shingle_set(text, 3) for _, text in data]
    similar = {(a, b) for a in range(len(data)) for b in range(a) if 100 * len(own[a] & own[b]) >= 90 * len(own[a] | own[b])}
    assert similar <= found and len(similar) > 5
    assert not any(1 in pair for pair in found)


@pytest.mark.parametrize("percent", [30, 80, 90, 99])
def test_similar_sizes_have_neighbouring_bands(percent):
    sizes = np.arange(1, 3000)
    for at, n in zip(range(len(sizes)), sizes.tolist()):
        fit = sizes[at:][100 * n >= percent * sizes[at:]]
        here, there = (int(ngrams.bands(np.array([x]), percent)[0]) for x in (n, fit[-1]))
        assert there in (here, here << 1 if here < 1 << 63 else 1)


# ------------------------------------------------------------------ substrings
@pytest.mark.parametrize(("width", "anchor"), [(13, 7), (5, 3)])
def test_removal_against_brute_force(docs, rows, width, anchor):
    expected = substring_cuts([r[:2] for r in rows], width)
    assert by_id(substrings.without_repeats(docs, width, anchor), "n_words", "n_removed", "kept_sha256") == expected


def test_words_of_texts_against_split():
    rng = random.Random(1)
    for _ in range(200):
        texts = [bytes(rng.choice(b"ab \t\n\x0b\x1c\xc3") for _ in range(rng.choice([0, 1, 5, 50, 400]))) for _ in range(rng.randrange(6))]
        texts.append(b"x" * rng.choice([0, 63, 64, 65, 200]) + b" y")
        hashes, n = words_of(texts)
        flat = [w for t in texts for w in t.split()]
        assert n.tolist() == [len(t.split()) for t in texts]
        assert len(set(flat)) == len(set(hashes.tolist())) == len(set(zip(flat, hashes.tolist())))
    hashes, n = words_of([b"ab c " * 500_000 + b"z" * 2_000_000 + b" ab", b"c ab"])  # more than one piece is summed
    assert n.tolist() == [1_000_002, 2] and hashes[0] == hashes[-1] == hashes[-3] and hashes[1] == hashes[-2]


def test_removal_with_a_full_filter(docs, rows, monkeypatch):
    """A filter that lets everything pass changes nothing."""
    monkeypatch.setattr(substrings, "bloom", lambda *a, **k: np.full(1 << 20, np.uint64(2**64 - 1)))
    expected = substring_cuts([r[:2] for r in rows], 13)
    assert by_id(substrings.without_repeats(docs), "n_words", "n_removed", "kept_sha256") == expected


@pytest.mark.parametrize("n", [0, 1, 7, 9, 12])
def test_removal_from_a_table_of_short_texts(spark, n):
    """Chunks of texts without a single edge: none of them loses a word."""
    text = " ".join(f"w{i}" for i in range(n))
    df = spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id int, text string")
    assert {d: r[:2] for d, r in by_id(substrings.without_repeats(df), "n_words", "n_removed").items()} == {1: (n, 0), 2: (n, 0), 3: (0, 0)}
    chunk = next(substrings._chunks([1], [text.encode()], 13, 7))
    assert len(chunk.anchors) == len(chunk.edge(chunk.first)) == len(chunk.of(chunk.check)) == 0


def test_whole_copies_are_removed_without_their_texts(spark):
    rng = random.Random(5)
    base, other = sentence(rng, 200), sentence(rng, 90)
    rows = [(9, base), (4, base), (4, base), (6, base.replace(" ", "\n")), (7, "x " + base), (2, other), (5, other), (None, base), (8, "a b c"), (3, "a b c")]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    later, others = substrings.copies(df)
    assert sorted(map(tuple, later.collect())) == [(5, 90), (6, 200), (9, 200)]
    looked_at = substrings.paths(df, np.full(1 << 14, np.uint64(2**64 - 1)), stay=substrings.Stay(df, others))
    assert {r["doc_id"] for r in looked_at.select("doc_id").distinct().collect()} == {2, 4, 7}
    found = sorted((r["doc_id"] or 0, r["n_words"], r["n_removed"], r["text"]) for r in substrings.without_repeats(df, with_text=True).collect())
    assert found == sorted([(9, 200, 200, ""), (4, 200, 0, base), (4, 200, 0, base), (6, 200, 200, ""), (7, 201, 200, "x"), (2, 90, 0, other),
                            (5, 90, 90, ""), (0, 200, 0, base), (8, 3, 0, "a b c"), (3, 3, 0, "a b c")])


def test_spans_against_one_match_after_the_other():
    rng = random.Random(6)
    found = sorted({(rng.randrange(3), p := rng.randrange(60), rng.randrange(1, 5), rng.randrange(2), max(p - rng.randrange(3), 0)) for _ in range(300)})
    expected = []
    for key in sorted({(d, s, p - q) for d, p, _, s, q in found}):
        runs = []
        for d, p, e, s, q in sorted(m for m in found if (m[0], m[3], m[1] - m[4]) == key):
            if runs and p <= runs[-1][2] - 9 + 1:
                runs[-1][2] = max(runs[-1][2], p + e - 1 + 9)
            else:
                runs.append([d, p, p + e - 1 + 9, s, q])
        expected += runs
    rng.shuffle(found)
    columns = substrings.spans(*(np.array(c) for c in zip(*found)), 9)
    assert [list(map(int, row)) for row in zip(*columns)] == expected
    assert all(len(c) == 0 for c in substrings.spans(*[np.empty(0, np.int64)] * 5, 9))


@pytest.mark.parametrize("bits", [20, 26, 28])
def test_filters_grow_with_their_values(spark, bits):
    keys = np.random.default_rng(bits).integers(0, 1 << 48, 20_000).astype(np.uint64)
    df = spark.createDataFrame(pd.DataFrame({"key": keys[:10_000].view(np.int64)}))
    table = substrings.bloom(df, "key", bits)
    assert substrings.in_bloom(table, keys[:10_000]).all() and substrings.in_bloom(table, keys[10_000:]).mean() < 0.01
    assert [substrings.filter_bits(n) for n in (0, 10_000, 4_000_000, 10**10)] == [20, 20, 27, 28]


def test_removal_of_nothing_and_nulls(spark, nothing):
    assert substrings.without_repeats(nothing).collect() == []
    text = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(None, text), (4, text), (4, text), (6, text + " more")], "doc_id bigint, text string")
    found = sorted((r["doc_id"], r["n_removed"], r["text"]) for r in substrings.without_repeats(df, with_text=True).collect() if r["doc_id"])
    assert found == [(4, 0, text), (4, 0, text), (6, 20, "more")]


# ------------------------------------------------------------------ mixing
def test_mix_meets_targets(docs, rows):
    found = mixing.mix(docs, carry=("lang",)).collect()
    assert len(found) == len(rows)
    size = {r[0]: len((r[1] or "").encode().split()) for r in rows}
    for r in found:
        assert r["size"] == size[r["doc_id"]] and r["taken"] == r["times"] * r["size"] and 0 <= r["times"] <= 3
    sources = sorted({r["source"] for r in found}, key=lambda s: (s is None, s))
    total = sum(size.values())
    weight = {s: i % 3 + 1 for i, s in enumerate(sources)}
    sums = {s: sum(r["size"] for r in found if r["source"] == s) for s in sources}
    capped: set = set()
    while True:
        rate = (total - sum(3 * sums[s] for s in capped)) / sum(w for s, w in weight.items() if s not in capped)
        more = {s for s in sources if s not in capped and 3 * sums[s] < rate * weight[s]}
        if not more:
            break
        capped |= more
    for s in sources:
        mine = [r for r in found if r["source"] == s]
        target = 3 * sums[s] if s in capped else rate * weight[s]
        assert mine[0]["target"] == pytest.approx(target)
        assert abs(sum(r["taken"] for r in mine) - target) <= max(r["size"] for r in mine) / 2 + 1e-6
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in found)


def test_mix_prefers_quality(spark):
    df = spark.createDataFrame([(i, "s", "word " * 100, 1.0 if i % 2 else 0.05) for i in range(400)], "doc_id bigint, source string, text string, w double")
    found = mixing.mix(df.withColumn("source", F.when(F.col("doc_id") < 200, "a").otherwise("b")).select("doc_id", "source", "text"),
                       weight=F.when(F.col("doc_id") % 2 == 1, 1.0).otherwise(0.05), share=0.5).collect()
    once = [r["doc_id"] for r in found if r["times"] > 0]
    assert sum(d % 2 for d in once) > 0.8 * min(len(once), 200) - 20


def test_mix_of_nothing(nothing, spark):
    assert mixing.mix(nothing).collect() == []
    empty = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id bigint, text string, source string")
    assert [r["taken"] for r in mixing.mix(empty).collect()] == [0, 0]


# ------------------------------------------------------------------ packing
def test_tokens_of_chunks_are_the_tokenizer_s(rows):
    from tokenizers import Tokenizer

    whole, parts = Tokenizer.from_file(tokenizer_path()), packing.WordIds(tokenizer_path())
    odd = ["<|endoftext|> x<|startoftext|>y", "İstanbul K å Å ǅ", "a b c\x1cd", "don't we'll\tI'm", "é ́x", "１２３ ①"]
    for text in [r[1] or "" for r in rows] + odd:
        assert np.frombuffer(parts(text.encode()), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_pack_places_every_piece(docs, rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    found = packing.pack(docs, tokenizer_path(), with_ids=True)
    pieces = {(r["doc_id"], r["piece"]): r for r in found.collect()}
    expected = {}
    for r in rows:
        ids = [*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 4096):
            expected[r[0], k // 4096] = (k, ids[k:k + 4096])
    assert pieces.keys() == expected.keys()
    for key, (start, ids) in expected.items():
        data = np.array(ids, "<u4").tobytes()
        r = pieces[key]
        assert (r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) == (start, len(ids), zlib.crc32(data), data)
    whole = {r["sequence_id"]: r for r in packing.sequences(found).collect()}
    places: dict = {}
    for r in pieces.values():
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for sequence, spans in places.items():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 4096 and len(whole[sequence]["ids"]) == 4 * at


@pytest.mark.parametrize("seed", range(6))
def test_plan_fills_sequences(seed):
    rng = np.random.default_rng(seed)
    room = 512
    counts = np.zeros(room + 1, np.int64)
    lengths = np.minimum(rng.lognormal(4.5 + seed / 4, 1, 3000).astype(int) + 1, room)
    np.add.at(counts, lengths, 1)
    runs = packing.plan(counts, room, grid=8)
    placed = np.zeros(room + 1, np.int64)
    used: dict = {}
    for length, rank, n, first, offset in runs.tolist():
        assert rank == placed[length]
        placed[length] += n
        for s in range(first, first + n):
            used.setdefault(s, []).append((offset, length))
    assert (placed == counts).all()
    for parts in used.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= room
    least = -(-lengths.sum() // room)
    # as good as best fit decreasing on single documents, up to one percent
    spaces: list[int] = []
    for length in sorted(lengths.tolist(), reverse=True):
        fit = [i for i, s in enumerate(spaces) if s >= length]
        if fit:
            best = min(fit, key=lambda i: spaces[i])
            spaces[best] -= length
        else:
            spaces.append(room - length)
    assert least <= len(used) <= 1.01 * len(spaces) + 1


def test_pack_of_nothing(nothing):
    assert packing.pack(nothing, tokenizer_path()).collect() == []


def test_a_word_is_kept_once():
    ids_of = packing.WordIds(tokenizer_path())
    text = "aa bb cc Aa bb."
    assert ids_of(text.encode()) == np.array(ids_of.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    caches = [x for x in vars(ids_of).values() if isinstance(x, packing._Recent)]
    assert sum(len(x.now) + len(x.old) for x in caches) == 5


def test_workers_drop_the_tokenizer_with_the_next_job(spark, docs):
    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(type(o).__name__ == "WordIds" for o in gc.get_objects())])], names=["n"])

    assert packing.pieces(docs, tokenizer_path()).count()
    assert {r["n"] for r in spark.range(0, 64, 1, 64).mapInArrow(held, "n bigint").collect()} == {0}


# ------------------------------------------------------------------ fingerprints
def test_edited_texts_and_likeness(spark, docs, rows):
    found = {r["doc_id"]: r for r in fingerprint.fingerprints(docs, rows_per_chunk=10).collect()}
    ordered = sorted((r[0], r[1] or "") for r in rows)
    for k, (doc_id, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = found[doc_id]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if edited == text:
            assert r["near_edited"] == 1
    prints: dict = {}
    for doc_id, text in ordered:
        prints.setdefault(text, set()).add(found[doc_id]["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())


def test_order_counts_and_small_edits_stay_near(spark):
    rng = random.Random(5)
    words = sentence(rng, 600).split()
    moved = words[300:] + words[:300]
    edited = [*words[:100], "changed", *words[101:]]
    swapped = words[:]
    rng.shuffle(swapped)
    data = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(swapped)), (4, " ".join(moved)), (5, "x " * 900)]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    rows = {r["doc_id"]: set(r["s"]) for r in fingerprint.with_signature(df, "text", "s").collect()}
    same = lambda a, b: len(rows[a] & rows[b]) / max(len(rows[a]), len(rows[b]))
    assert same(1, 2) > 0.85 and same(1, 3) < 0.05
    assert 0.2 < same(1, 4) < 0.8  # the same k-mers, but half of the pairs change order
    assert len(rows[5]) > 40  # repeats of one k-mer count by their number


def test_occurrences_are_numbered_in_a_plain_version(spark):
    """A text that repeats k-mers differs from one that has them once."""
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f a b c d e f"), (3, "a b c d e f")], "doc_id bigint, text string")
    rows = {r["doc_id"]: r["s"] for r in fingerprint.with_signature(df, "text", "s").collect()}
    assert rows[1] == rows[3] != rows[2]


def test_fingerprint_edge_cases(spark, nothing):
    assert fingerprint.fingerprints(nothing).collect() == []
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "abc")], "doc_id bigint, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"aba").hexdigest() and one["near_next"] == 1
    df = spark.createDataFrame([(None, "n"), (3, "b"), (3, "a"), (8, None)], "doc_id bigint, text string")
    found = sorted((r["n_chars"], r["near_next"]) for r in fingerprint.fingerprints(df, 1).collect())
    assert found == [(0, 0.0), (1, 0.0), (1, 0.0), (1, 0.0)]


def test_fingerprints_run_no_python(docs):
    plan = fingerprint.fingerprints(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# ------------------------------------------------------------------ language
def test_language_of_held_out_texts(spark, folder):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held", langid.held_out())
    model = langid.fit(docs.where("NOT held"))
    found = langid.predict(docs.where("held"), model, keep=("doc_id", "lang")).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.98 * len(found)
    ids = [r["doc_id"] for r in docs.where("held").select("doc_id").collect()]
    assert ids and all(zlib.crc32(str(i).encode()) % 5 == 0 for i in ids)


def test_words_first_then_shorter_grams():
    model = {"languages": ["a", "b"], "words": {"known": np.array([-1.0, -9.0])},
             "grams": [{}, {"z": np.array([-2.0, -1.0])}, {}, {"xyz": np.array([-1.0, -5.0])}, {}, {}]}
    scorer = langid.Scorer(model)
    assert scorer(b"known")[0] == "a"
    assert scorer(b"wxyzw") == scorer(b"(wxyzw),") and scorer(b"wxyzw")[0] == "a"  # three letters go before one
    assert scorer(b"wzw")[0] == "b"
    assert scorer("12 ... 　".encode()) == ("und", 0.0) and scorer(b"") == ("und", 0.0)
    assert scorer(b"qq") == ("a", 0.5)  # nothing known: a tie


def test_language_edge_cases(spark, nothing):
    empty = langid.fit(nothing)
    assert empty["languages"] == []
    df = spark.createDataFrame([(1, None), (2, "..."), (3, "the of")], "doc_id bigint, text string")
    assert {tuple(r) for r in langid.predict(df, empty).collect()} == {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)}
    assert langid.predict(nothing, empty).collect() == []


def test_workers_keep_no_object_per_known_word(spark, monkeypatch):
    words = {f"w{i}w": np.array([-1.0, -9.0]) for i in range(20_000)}
    sent, send = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(pickle.dumps(value)) or send(self, value))
    df = spark.createDataFrame([(1, "w19999w w7w"), (2, "")], "doc_id bigint, text string")
    found = langid.predict(df, {"languages": ["a", "b"], "words": words, "grams": [{}, {"w": np.array([-9.0, -1.0])}]})
    tracemalloc.start()
    kept = pickle.loads(sent[-1])
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert kept and size < 50 * len(words)
    assert [r["lang_pred"] for r in found.orderBy("doc_id").collect()] == ["a", "und"]


# ------------------------------------------------------------------ personal data
def plain_base(text):
    """The patterns as they are written, with plain regular expressions."""
    import re

    found = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
                          ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or \
                kind == "card" and 12 <= len(digits) <= 19 and pii.luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15
            if ok:
                found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_are_the_patterns():
    rng = random.Random(11)
    alphabet = ["a", "b@c.de", "@", ".", "+", "-", " ", "1", "12", "255", "0", "(", ")", "4111 1111 1111 1111", "+1 (988) 555-2485", "1.2.3.4", "é", "\n", "_", "%", "000256"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 14)))
        assert pii.base_spans(text) == plain_base(text), text


def test_long_texts_take_linear_time():
    for part in ("a", "1", "1 ", "@", "a@", "+1", "1.", "((", "+"):
        text = part * (200_000 // len(part))
        pii.spans_of(text, np.zeros((pii.N_FEATURES, 4)) - 1)


def trained():
    rng = random.Random(2)
    samples = []
    for i in range(240):
        d = [str(rng.randrange(10)) for _ in range(15)]
        card = next("".join(["4", *d[1:], str(c)]) for c in range(10) if pii.luhn("".join(["4", *d[1:], str(c)])))
        samples.append(["of ann%d@mail%d.example.com in" % (i, i % 9), f"to +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} on",
                        f"at {card} he", f"is {rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)} an"][i % 4])
    return pii.fit(samples)


def test_model_adds_other_formats_and_keeps_the_base():
    weights = trained()
    text = "call 988-555-2485 or (415) 555-0199, card 4111.1111.1111.1111, mail jörg@büro.example.com; on 2024-05-17 we paid 1234567.50 for 20240517"
    base, every = pii.spans_of(text, weights)
    assert set(base) <= set(every)
    found = {(k, text[a:b]) for k, a, b in every}
    assert ("phone", "988-555-2485") in found and ("phone", "(415) 555-0199") in found
    assert ("card", "4111.1111.1111.1111") in found
    assert not any("2024" in t or "1234567" in t for _, t in found)


def test_counts_are_of_the_base_spans(spark):
    texts = ["call 988-555-2485 or +1 (415) 555-0199", "card 4111.1111.1111.1111 of jörg@büro.example.com", "a@b.cd at 1.2.3.4", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    added = 0
    for row in pii.find(df, trained()).collect():
        base = plain_base(texts[row["doc_id"]] or "")
        assert [row[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert row["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        added += row["spans"].count(":") // 2 - len(base)
    assert added >= 2


def test_redaction_and_empty_tables(spark, nothing):
    assert pii.redacted("a b@c.de 1.2.3.4", [("email", 2, 8), ("ip", 9, 16)]) == "a <email> <ip>"
    assert pii.redacted("abc", []) == "abc"
    assert pii.redacted("abcdef", [("card", 1, 4), ("phone", 2, 5)]) == "a<card>f"
    assert pii.find(nothing, pii.fitted(nothing)).collect() == []
    df = spark.createDataFrame([(1, None), (1, "x@y.zz"), (None, "")], "doc_id bigint, text string")
    found = sorted((r["n_email"], r["spans"]) for r in pii.find(df, None).collect())
    assert found == [(0, ""), (0, ""), (1, "email:0:6")]
