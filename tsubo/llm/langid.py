"""Language identification, word first.

A known word scores by its log frequency in each language. An unseen word falls back to its
character n-grams, the longest length of which any is known, down to single characters. A text's
score is the sum over its words; the prediction is the language with the largest sum.

The model is fitted on a bounded sample (`rows_per_language` labelled documents per language,
chosen by a hash of the id) and holds at most `most_words` words and n-grams per length and
language, so it can travel to every task. Prediction covers every whole text.

Cases: a text that is null or has no letter is `und` with score 0; so is every text when there
is no labelled row. Ties go to the language that comes first by name. Repeated rows are predicted
each; an empty table gives no rows; other columns are kept out of the result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsubo.llm.common import give_back, text_bytes

ROWS_PER_LANGUAGE = 400
MOST_WORDS = 15_000
LONGEST = 5
FOLDS = 5
UNKNOWN = "und"
CACHED_WORDS = 300_000
# punctuation at the ends of a word says nothing about its language
EDGES = " \t\n\r\x0b\x0c.,;:!?\"'()[]{}<>|*#$%&+=_/\\-–—…«»“”‘’¡¿0123456789"


def held_out(doc_id: str | Column = "doc_id", folds: int = FOLDS) -> Column:
    """Whether a document is kept from training: crc32 of the id as text, modulo the folds, is 0."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(docs: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE, most_words: int = MOST_WORDS,
        longest: int = LONGEST) -> dict:
    """The model of docs(text, lang, doc_id): languages, and log frequencies per word and n-gram."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select(
        "lang", "text", F.xxhash64("doc_id", F.lit(5)).alias("_pick"))
    # every label's share of hashes below a cut, then the exact smallest: languages are few
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return {"languages": [], "words": {}, "grams": [{} for _ in range(longest + 1)]}
    wanted = F.lit(False)
    for lang in languages:
        share = min(1.0, rows_per_language / counts[lang])
        cut = int((share - 0.5) * 2 * (2**63 - 1)) if share < 1 else 2**63 - 1
        wanted = wanted | ((F.col("lang") == lang) & (F.col("_pick") <= F.lit(max(min(cut, 2**63 - 1), -2**63)).cast("bigint")))
    sample = labelled.where(wanted)
    word = F.explode(F.split(F.lower("text"), r"[^\p{L}\p{M}]+")).alias("word")
    words = sample.select("lang", word).where("word <> ''").groupBy("word", "lang").agg(F.count("*").alias("n"))
    frame = words.toPandas()  # bounded by the sample
    index = {lang: i for i, lang in enumerate(languages)}

    def logs(table: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        total = np.sum(list(table.values()), axis=0) + 1.0
        return {k: np.log((v + 0.1) / (total + 0.1 * len(table))) for k, v in table.items()}

    grams: list[dict] = [{} for _ in range(longest + 1)]
    known: dict[str, np.ndarray] = {}
    frame = frame.sort_values(["n", "word"], ascending=[False, True])
    for text, lang, n in zip(frame["word"], frame["lang"], frame["n"]):
        at = index[lang]
        if text in known or len(known) < most_words * len(languages):
            known.setdefault(text, np.zeros(len(languages)))[at] += n
        marked = f"^{text}$"
        for size in range(1, longest + 1):
            table = grams[size]
            for i in range(len(marked) - size + 1):
                gram = marked[i:i + size]
                if gram in table or len(table) < most_words * len(languages):
                    table.setdefault(gram, np.zeros(len(languages)))[at] += n
    # words seen once teach n-grams only
    known = {k: v for k, v in known.items() if v.sum() > 1}
    return {"languages": languages, "words": logs(known) if known else {}, "grams": [logs(t) if t else {} for t in grams]}


def packed(model: dict) -> dict:
    """The model as it travels: one matrix for words and n-grams, and a text per table with the names of its rows, one a
    line (no word holds a line feed). Every worker keeps it, so it must not be an object per word."""
    tables = [model["words"], *model["grams"]]
    rows = [row for table in tables for row in table.values()]
    return {"languages": model["languages"], "tables": ["\n".join(table) for table in tables],
            "matrix": np.array(rows).reshape(-1, max(len(model["languages"]), 1))}


class Scorer:
    """Scores texts with a model, packed or not; scores of words are kept in a bounded cache."""

    def __init__(self, model: dict, room: int = CACHED_WORDS):
        model = model if "matrix" in model else packed(model)
        self.languages, self.matrix, self.room = model["languages"], model["matrix"], room
        tables, start = [], 0
        for names in model["tables"]:
            names = names.split("\n") if names else []
            tables.append(dict(zip(names, range(start, start + len(names)))))
            start += len(names)
        self.words, *self.grams = tables
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.scores = np.zeros((1024, self.matrix.shape[1]))
        self.n = 1  # row 0: chunks without letters

    def _rows_of(self, word: str) -> list[int]:
        """Matrix rows whose mean is the word's score: its own, else those of its longest known n-grams."""
        found = self.words.get(word)
        if found is not None:
            return [found]
        marked = f"^{word}$"
        for size in range(min(len(self.grams) - 1, len(marked)), 0, -1):
            table = self.grams[size]
            hits = [table[g] for g in [marked[i:i + size] for i in range(len(marked) - size + 1)] if g in table]
            if hits:
                return hits
        return []

    def _learn(self, chunks: list[bytes]) -> None:
        words: dict[str, int] = {}
        for chunk in chunks:
            word = chunk.decode("utf-8", "replace").strip(EDGES).lower()
            if word.isalpha() or any(map(str.isalpha, word)):
                self.known[chunk] = self.n + words.setdefault(word, len(words))
            else:
                self.known[chunk] = 0
        if not words:
            return
        while self.n + len(words) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
        found = [self._rows_of(word) for word in words]
        sizes = np.array([len(f) for f in found])
        has = np.flatnonzero(sizes)
        if len(has):
            flat = self.matrix[[row for f in found for row in f]]
            starts = (np.cumsum(sizes) - sizes)[has]
            self.scores[self.n + has] = np.add.reduceat(flat, starts, axis=0) / sizes[has, None]
        # rows are used again after the cache was cleared
        self.scores[self.n + np.flatnonzero(sizes == 0)] = 0
        self.n += len(words)

    def __call__(self, text: bytes) -> tuple[str, float]:
        if not self.languages:
            return UNKNOWN, 0.0
        chunks = text.split()
        if len(self.known) > self.room:
            self._clear()
        new = set(chunks).difference(self.known)
        if new:
            self._learn(sorted(new))
        ids = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))
        different, n = np.unique(ids, return_counts=True)
        if len(different) and different[0] == 0:
            different, n = different[1:], n[1:]
        if not len(different):
            return UNKNOWN, 0.0
        total = n @ self.scores[different]
        # words of a text are not independent: the evidence is damped by the root of their number
        total = (total - total.max()) / math.sqrt(n.sum())
        odds = np.exp(total)
        best = int(np.argmax(odds))
        return self.languages[best], float(odds[best] / odds.sum())


def predict(docs: DataFrame, model: dict, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns to keep with lang_pred and score for every text."""
    shared = docs.sparkSession.sparkContext.broadcast(packed(model))  # at most most_words rows per table and language

    def run(batches):
        give_back()  # what other jobs have left in this worker
        scorer = Scorer(shared.value)
        for batch in batches:
            found = [scorer(t) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], names=[*keep, "lang_pred", "score"])
        del scorer
        give_back()

    rows = docs.select(*keep, text_bytes(text).alias("_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(run, f"{kinds}, lang_pred string, score double")
