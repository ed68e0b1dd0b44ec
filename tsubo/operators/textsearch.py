"""Keyword search over text columns, without an index."""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsubo import schemas, vocab
from tsubo.operators.facets import facets
from tsubo.operators.paging import sort_columns, top

_NOT_WORD = r"[^\p{L}\p{N}]+"
_WORD = r"[\p{L}\p{N}]"

# --- fixed values: edits allowed from this word length on ------------------
TYPO_LENGTHS = [(9, 2), (5, 1)]


def query_tokens(query: str) -> list[str]:
    """Distinct lower-case words of the query, in order."""
    words = re.split(r"[\W_]+", query.lower())
    return list(dict.fromkeys(w for w in words if w))


def _exact(text: Column, token: str, prefix: bool) -> Column:
    """Whole word or word start. The plain containment test runs first and
    spares most rows the pattern."""
    pattern = rf"(?<!{_WORD}){re.escape(token)}" + ("" if prefix else rf"(?!{_WORD})")
    return text.contains(token) & text.rlike(pattern)


def allowed_edits(token: str) -> int:
    return next((edits for length, edits in TYPO_LENGTHS if len(token) >= length), 0)


def vocabulary(df: DataFrame, fields: list[str]) -> DataFrame:
    """(word): the distinct lower-case words of the fields, combined before the shuffle."""
    text = F.lower(F.concat_ws(" ", *[F.col(f).cast("string") for f in fields]))
    words = df.select(F.explode(F.array_distinct(F.split(text, _NOT_WORD))).alias("word"))
    return words.filter(F.col("word") != "").distinct()


def _deletions(word: Column, edits: int) -> Column:
    """The word and all that is left of it after up to `edits` deletions of a letter."""
    def shorter(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.left(w, i - 1), F.substr(w, i + 1)))

    found = F.array(word)
    for _ in range(edits):
        found = F.array_distinct(F.concat(found, F.flatten(F.transform(found, shorter))))
    return found


def _left_after_deletions(word: str, edits: int) -> set[str]:
    found = {word}
    for _ in range(edits):
        found |= {w[:i] + w[i + 1:] for w in found for i in range(len(w))}
    return found


def near_words(words: DataFrame, tokens: list[str]) -> DataFrame:
    """(token, word): other words few enough edits away from a token.

    Two words k edits apart have something in common after k deletions in each, so candidates meet by
    equality of what is left, and only they are measured. Words of unlike length are dropped first.
    """
    keys = [(t, allowed_edits(t), k) for t in tokens for k in _left_after_deletions(t, allowed_edits(t))]
    keyed = F.broadcast(words.sparkSession.createDataFrame(keys, "token string, edits int, _left string"))  # a few dozen rows a token

    def alike(edits: int) -> Column:
        near = [F.length("word").between(len(t) - edits, len(t) + edits) for t in tokens if allowed_edits(t) == edits]
        return functools.reduce(lambda a, b: a | b, near, F.lit(False))

    most = sorted({allowed_edits(t) for t in tokens}, reverse=True)
    left = functools.reduce(lambda c, e: c.when(alike(e), _deletions(F.col("word"), e)), most, F)
    some = words.filter(functools.reduce(lambda a, b: a | b, [alike(e) for e in most]))
    met = some.select("word", F.explode(left).alias("_left")).join(keyed, "_left").select("token", "edits", "word").distinct()
    return met.filter((F.levenshtein("word", "token") <= F.col("edits")) & (F.col("word") != F.col("token"))).select("token", "word")


def _near(words: str, token: str) -> Column:
    """Some word of the array is few enough edits away from the token."""
    edits = allowed_edits(token)

    def near(word: Column) -> Column:
        fits = F.length(word).between(len(token) - edits, len(token) + edits)
        return fits & (F.levenshtein(word, F.lit(token), edits) >= 0)

    return F.exists(words, near)


# near words beyond these numbers are looked up in the words of a row, or not listed, and the rows are measured
FEW_WORDS = 48
LISTED_WORDS = 10_000


def _listed_near(df: DataFrame, fields: list[str], tokens: list[str], words: DataFrame | None) -> dict[str, list[str]] | None:
    words = vocabulary(df, fields) if words is None else words
    found = near_words(words, tokens).limit(LISTED_WORDS + 1).collect()
    if len(found) > LISTED_WORDS:
        return None
    return {t: sorted(r["word"] for r in found if r["token"] == t) for t in tokens}


def scored(
    df: DataFrame, query: str, fields: list[str], typos: bool = False, prefix_last: bool = False, words: DataFrame | None = None
) -> DataFrame:
    """Rows that match a word of the query, with score and best_rank.

    score is the number of query words found in any field; best_rank is the
    position of the most important field with a hit, 1 being the first.
    Everything is a row-wise expression, so a search is one scan without a
    shuffle. An empty query keeps every row.
    With typos, the near words are looked up first in the distinct words of the rows, or in `words`, a
    kept vocabulary that covers them.
    """
    tokens = query_tokens(query)
    if not tokens:
        return df.withColumns({"score": F.lit(0), "best_rank": F.lit(0)})
    texts = {f"_text_{i}": F.lower(F.coalesce(F.col(f), F.lit(""))) for i, f in enumerate(fields)}
    marked = df.withColumns(texts)
    fuzzy = [t for t in tokens if typos and allowed_edits(t)]
    near = _listed_near(df, fields, fuzzy, words) if fuzzy else {}
    few = near is not None and all(len(words) <= FEW_WORDS for words in near.values())
    if not few:
        distinct_words = {f"_words_{i}": F.array_distinct(F.split(f"_text_{i}", _NOT_WORD)) for i in range(len(fields))}
        marked = marked.withColumns(distinct_words)

    def hit(i: int, token: str) -> Column:
        exact = _exact(F.col(f"_text_{i}"), token, prefix_last and token == tokens[-1])
        if token not in fuzzy or (near is not None and not near[token]):
            return exact
        if few:
            return functools.reduce(lambda a, w: a | _exact(F.col(f"_text_{i}"), w, False), near[token], exact)
        return exact | (_near(f"_words_{i}", token) if near is None else F.exists(f"_words_{i}", lambda w: w.isin(near[token])))

    flags = {f"_hit_{i}_{j}": hit(i, t) for i in range(len(fields)) for j, t in enumerate(tokens)}
    marked = marked.withColumns(flags).drop(*texts)

    def any_of(names: list[str]) -> Column:
        return functools.reduce(lambda a, b: a | b, [F.col(n) for n in names])

    found = [any_of([f"_hit_{i}_{j}" for i in range(len(fields))]).cast("int") for j in range(len(tokens))]
    score = functools.reduce(lambda a, b: a + b, found)
    ranks = [F.when(any_of([f"_hit_{i}_{j}" for j in range(len(tokens))]), i + 1) for i in range(len(fields))]
    matched = marked.withColumn("score", score).withColumn("best_rank", F.coalesce(*ranks))
    return matched.filter(F.col("score") > 0).select(*df.columns, "score", "best_rank")


def search(
    df: DataFrame,
    query: str,
    fields: list[str] | None = None,
    ident: str = "id",
    condition: Column | None = None,
    sort: str | None = None,
    newest_by: str = "created_at",
    typos: bool = False,
    prefix_last: bool = False,
) -> tuple[DataFrame, list[Column]]:
    """Matching rows and the order to show them in."""
    filtered = df if condition is None else df.filter(condition)
    rows = scored(filtered, query, fields or vocab.SEARCH_FIELDS, typos, prefix_last)
    if sort:
        return rows, sort_columns(sort, newest_by, ident)
    return rows, [F.desc("score"), F.asc("best_rank"), F.asc(ident)]


def search_page(
    df: DataFrame, query: str, limit: int = vocab.SEARCH_LIMIT, offset: int = 0, **options
) -> DataFrame:
    rows, order = search(df, query, **options)
    return top(rows, order, limit, offset)


def search_answer(
    df: DataFrame,
    query: str,
    facet_fields: list[str],
    limit: int = vocab.SEARCH_LIMIT,
    offset: int = 0,
    **options,
) -> dict[str, DataFrame]:
    """Hits, exact total and facets of one search.

    They share the filtered rows. Persist `rows` before running more than one
    of them when the filter is costly.
    """
    rows, order = search(df, query, **options)
    return {
        "rows": rows,
        "hits": top(rows, order, limit, offset),
        "total": rows.agg(F.count("*").alias("total")),
        "facets": facets(rows, facet_fields),
    }


def hit_rows(hits: DataFrame, column: str = "hit") -> DataFrame:
    """JSON hits -> typed rows; absent text is '' and absent numbers are NULL."""
    row = F.from_json(column, schemas.INDEX_DOCUMENT).alias("_row")
    typed = hits.select(row).select("_row.*")
    texts = [f.name for f in schemas.INDEX_DOCUMENT if f.dataType.simpleString() == "string"]
    return typed.withColumns({t: F.coalesce(t, F.lit("")) for t in texts})
