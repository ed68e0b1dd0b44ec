"""Filter audit and token counts against plain versions."""

import itertools
import random

import pytest

from tests.llm.data import DOC, documents
from tsubo.llm import filteraudit, tokencount
from tsubo.llm.queries import piece_path


# ------------------------------------------------------------------ filters
def failures(rows):
    """Failed filters of each row (doc_id, text, lang)."""
    found = []
    for doc_id, text, _ in rows:
        text = text or ""
        words = text.encode().split()
        failed = {"A"} if len(words) < 100 else set()
        if 100 * len(set(words)) < 80 * len(words):
            failed.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text):
            failed.add("C")
        if any(c in "#$%&*|" for c in text):
            failed.add("D")
        if doc_id is not None and any(o is not None and o < doc_id and (t or "") == text for o, t, _ in rows):
            failed.add("E")
        found.append(failed)
    return found


def plain_audit(rows, labels):
    failed = failures(rows)
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    out = {}
    for part in {lang or "" for _, _, lang in rows}:
        own = [(d, f) for (d, _, lang), f in zip(rows, failed) if (lang or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                gone = [(d, f) for d, f in left if name in f]
                left = [(d, f) for d, f in left if name not in f]
                shapley[name] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(name in f for _, f in own) - len(gone), sum(f == {name} for _, f in own),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), name]
        for key, row in out.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(d, t, lang, 1, "m", "x", 2) for d, t, lang in rows],
                                 "doc_id bigint, text string, lang string, n int, mask string, digest string, id int")
    marks = spark.createDataFrame([(*r, "p") for r in labels], "doc_id bigint, quality int, toxic int, part string")
    found = filteraudit.audit(docs, marks).collect()
    result = {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in found}
    assert len(result) == len(found)
    return result


def test_audit_of_every_order(spark):
    rng = random.Random(1)
    rows = [(r[0], r[1], r[2]) for r in documents(n=15)]
    rows += [(900 + i, "AB " * 40 + rng.choice("#$ab"), rng.choice(["de", "en", "", None])) for i in range(20)]
    rows += [(901, "AB " * 40 + "#", "de"), (None, "", "en"), (None, "one", None), (5000, "one", "fr"), (5000, "one", "fr"), (5000, "one", "de")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d, _, _ in rows[::2]] + [(901, 1, 1), (901, 0, 0), (None, 1, 1), (77777, 1, 1)]
    assert audited(spark, rows, labels) == plain_audit(rows, labels)


def test_audit_of_an_empty_table(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}


def test_walk_visits_every_subset():
    rng = random.Random(2)
    cells = {m: (rng.randrange(9), rng.randrange(9)) for m in range(32) if rng.random() < 0.7}
    states = filteraudit.survivors(cells)
    for subset in range(32):
        assert states[subset] == tuple(sum(c[i] for m, c in cells.items() if not m & subset) for i in (0, 1))


# ------------------------------------------------------------------ token counts
@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=piece_path())
    return lambda text: len(model.encode(text))


def test_counts_are_those_of_the_library(library):
    rng, count = random.Random(3), tokencount.MergeCounts(piece_path(), room=2000)
    marks = "ab <>/s\n\t\r\x00▁ e.,'日本語é　\U0001F600 unk  0x1.)(\"-_:;=+#$²"
    pieces = [p.replace(tokencount.SPACE, " ") for p in count.ranks]
    texts = ["", " ", "▁", "<s> </s> <unk> <0x0A>", "_." * 3000, "a" * 5000 + "_" * 500, " " * 4000, "日." * 2000, "word " * 4000, "x" * 20000]
    for _ in range(4000):
        texts.append("".join(rng.choice(marks) for _ in range(rng.randrange(40))))
        texts.append("".join(rng.choice(pieces) for _ in range(rng.randrange(10))))
        texts.append("".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(32, 0x3000), rng.randrange(0xE000, 0x20000)])) for _ in range(9)))
    for text in texts:
        assert count(text) == library(text), text
    assert count.known.older  # the cache was turned over


def test_merges_without_chunks(library):
    count = tokencount.MergeCounts(piece_path())
    for text in ["Hello  world, this is it.", "  two  spaces\n\n and lines", "1234567 don't"]:
        assert count.chunk(count.normalize(text)) == library(text)


def test_token_counts(spark, library):
    rows = documents(n=10) + [(8000, "a" * 30000, "en", "s", 1, "k", 1, "p", "t"), (8000, "a", "en", "s", 1, "k", 1, "p", "t")]
    found = tokencount.token_counts(spark.createDataFrame(rows, DOC), piece_path(), limit=100).collect()
    want = [(r[0], len((r[1] or "").encode()), library(r[1] or ""), library(r[1] or "") > 100) for r in rows]
    assert sorted(map(tuple, found)) == sorted(want)
    assert any(r["over_limit"] for r in found) and not all(r["over_limit"] for r in found)
    assert tokencount.token_counts(spark.createDataFrame([], DOC), piece_path()).collect() == []
