"""Small hard inputs and brute-force versions of the operators."""

import hashlib
import random

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, size int, piece string, token string"
VOCABULARY = ["the", "of", "and", "Rent", "house", "near", "station", "a", "tree", "über", "naïve", "x1", "42", "garden", "floor"]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) + str(rng.randrange(40)) for _ in range(n))


def documents(seed: int = 3, n: int = 40) -> list[tuple]:
    """Nulls, empty and blank texts, copies, near copies, shared passages, a very long text, a hot source."""
    rng = random.Random(seed)
    passage = sentence(rng, 30)
    base = sentence(rng, 120)
    texts = [None, "", " \t\n", "one", "one two", "ONE two", base, base, base.upper(), base.replace(" ", "\n"), passage,
             "word " * 300, "日本語のテキスト" * 60, sentence(rng, 9000), "é" * 500]
    for i in range(n):
        words = base.split()
        words[rng.randrange(len(words))] = f"new{i}"
        if i % 3:
            words[rng.randrange(len(words))] = f"other{i}"
        texts.append(" ".join(words))
        texts.append(sentence(rng, rng.randrange(1, 60)) + " " + passage + " " + sentence(rng, rng.randrange(0, 40)))
        texts.append(sentence(rng, rng.randrange(3, 90)))
    rows = []
    for i, text in enumerate(texts):
        source = None if i % 17 == 0 else "hot" if i % 3 == 0 else f"s{i % 5}"
        rows.append((i * 7 % len(texts) * 3, text, None if i % 11 == 0 else "en", source, len(text) if text else None, "k", 1, "p", "t"))
    return rows


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def shingle_set(text: str | None, width: int) -> frozenset:
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(max(1, len(w) - width + 1)))


def grouped(links: list[tuple[int, int]], nodes) -> dict:
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def jaccard_groups(rows: list[tuple[int, str | None]], width: int, percent: int) -> dict:
    """doc_id -> (set size, component)."""
    sets = {d: shingle_set(t, width) for d, t in rows}
    links = [(a, b) for a, x in sets.items() for b, y in sets.items()
             if a < b and x and y and 100 * len(x & y) >= percent * len(x | y)]
    parts = grouped(links, sets)
    return {d: (len(sets[d]), parts[d]) for d in sets}


def substring_cuts(rows: list[tuple[int, str | None]], width: int) -> dict:
    """doc_id -> (words, removed, sha256 of what is kept)."""
    texts = {d: words(t) for d, t in rows}
    first: dict = {}
    for d in sorted(texts):
        for i in range(len(texts[d]) - width + 1):
            first.setdefault(tuple(texts[d][i:i + width]), d)
    out = {}
    for d, w in texts.items():
        gone = set()
        for i in range(len(w) - width + 1):
            if first[tuple(w[i:i + width])] < d:
                gone.update(range(i, i + width))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out
