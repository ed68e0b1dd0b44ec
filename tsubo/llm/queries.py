"""The queries opN_<name>: production parameters over whole tables, and SQL twins where there are any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsubo.llm import (
    conversations, epsilon, filteraudit, fingerprint, langid, mixing, ngrams, packing, pii, substrings, tokencount, urlfilter,
    warc,
)
from tsubo.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(run: Callable[[SparkSession, str], DataFrame]):
    QUERIES[run.__name__] = run
    return run


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a page's label is that of the document with its id: bad if toxic
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("toxic").alias("bad"))
    return urlfilter.judged(table(spark, sf_dir, "pages"), labels)


@query
def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngrams.similar_documents(table(spark, sf_dir, "documents"))


@query
def op2_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    # with the number of links of each document, so all pairs are looked at
    return ngrams.linked_documents(table(spark, sf_dir, "documents"))


@query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fitted(docs))


@query
def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.without_repeats(table(spark, sf_dir, "documents"))


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where(~F.col("held_out")))
    return langid.predict(docs, model, keep=("doc_id", "held_out"))


@query
def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epsilon.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # pages carry no time; their id stands in for seconds since the start of the crawl
    captures = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.col("html").alias("payload"),
        F.date_format(F.timestamp_seconds(F.col("page_id") + 1_577_836_800), "yyyyMMddHHmmss").alias("capture_time"))
    return warc.archive_round_trip(captures).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "history_position")


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(conversations.damaged(table(spark, sf_dir, "conversations")), "present")


@query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filteraudit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@query
def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.token_counts(table(spark, sf_dir, "documents"), piece_path())


SQL["op10_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host,
                  lower(regexp_extract(url, '://[^/?#]*([^#]*)', 1)) AS rest FROM pages),
     k AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@|:\d*$', '', 'g'), '^www\d*\.', '') AS name FROM p),
     q AS (SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
                  coalesce(array_to_string(list_reverse(string_split(name, '.')), ',') || ')' || rest, ')') AS url_key FROM k),
     m AS (SELECT payload_digest, max(page_id) AS first FROM q WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, q.payload_digest,
       CASE WHEN page_id < first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < first THEN first END AS refers_to,
       row_number() OVER (ORDER BY url_key, page_id NULLS FIRST) - 1 AS history_position  -- times rise with the id
FROM q LEFT JOIN m ON q.payload_digest = m.payload_digest"""


# ------------------------------------------------------------------ SQL twins of pair and path operators
_WORDS = r"list_filter(regexp_split_to_array({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op2_ngram_join"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS ws FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 2), ' ') AS s
           FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
     link AS (SELECT x, y FROM shared JOIN n p ON x = p.doc_id JOIN n q ON y = q.doc_id WHERE 100 * k >= 90 * (p.n + q.n - k)),
     step AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
     reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT a, y FROM reach JOIN step ON b = x)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) ON a = w.doc_id"""

SQL["op7_substring_dedup"] = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
     win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS s
             FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
     own AS (SELECT s, min(doc_id) AS o FROM win GROUP BY s),
     gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN own ON win.s = own.s CROSS JOIN (SELECT unnest(range(13)) AS k)
              WHERE o < doc_id),
     word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
     kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS k
              FROM word WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.doc_id = word.doc_id AND gone.p = word.p) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""

SQL["op9_near_vectors"] = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
     link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id < b.vec_id
              WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
     step AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
     n AS (SELECT x, count(*) AS n FROM step GROUP BY x),
     reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT a, y FROM reach JOIN step ON b = x),
     part AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v LEFT JOIN n ON vec_id = x JOIN part ON vec_id = a"""



def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))"
    bit = "xor(acc >> 1, CASE WHEN acc & 1 = 1 THEN 3988292384 ELSE 0 END)"
    return f"xor(list_reduce(list_prepend(4294967295, {steps}), lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE {bit} END), 4294967295)"


def _repair_sql() -> str:
    """The cheapest edits by one pass over the rows: four places of the pattern, each with its least (cost, audit, text)."""
    never = 1_000_000_000_000

    def after(place: str, cost: str, letter: str, line: str = "''", where: str = "true") -> str:
        return (f"{{'c': CASE WHEN {where} THEN {place}.c + {cost} ELSE {never} END, 'a': {place}.a || '{letter}', "
                f"'t': {place}.t || {line}}}")

    def row(name: str) -> str:
        return f"chr(10) || {name} || ':' || x.t"

    kept, free = row("x.r"), "NOT x.m"
    s0, s1, s2, s3 = (f"acc.s[{i}]" for i in range(1, 5))
    cut = "CAST(x.x AS BIGINT)"
    step = ", ".join([
        after(s0, "3", "D"),
        f"list_min([{after(s1, '3', 'D')}, {after(s0, cut, 'K', kept, free + " AND x.i = 's'")}])",
        f"list_min([{after(s2, '3', 'D')}, " + ", ".join(
            after(s, cut, "K", kept, free + " AND x.i = 'u'") + ", " + after(s, f"2 + {cut}", "R", row("'user'"), free)
            for s in (s0, s1, s3)) + "])",
        f"list_min([{after(s3, '3', 'D')}, {after(s2, cut, 'K', kept, free + " AND x.i = 'a'")}, "
        f"{after(s2, '2 + ' + cut, 'R', row("'assistant'"), free)}])"])
    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"

    def inserted(state: str) -> str:
        two = f"list_min([n[3], {after('n[1]', '2', 'I', user)}, {after('n[2]', '2', 'I', user)}, {after('n[4]', '2', 'I', user)}])"
        users = f"list_transform([{state}], lambda n: [n[1], n[2], {two}, n[4]])[1]"
        three = f"list_min([n[4], {after('n[3]', '2', 'I', assistant)}])"
        return f"list_transform([{users}], lambda n: [n[1], n[2], n[3], {three}])[1]"

    no_place = f"{{'c': {never}, 'a': '', 't': ''}}"
    begin = inserted(f"[{{'c': 0, 'a': '', 't': ''}}, {no_place}, {no_place}, {no_place}]")
    return rf"""
WITH base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                     {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS f
              FROM conversations),
     damaged AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
                        CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
                 FROM base, unnest([1, 2]) u(again) WHERE f <> 0 AND (again = 1 OR f = 3)),
     placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS p FROM damaged),
     seen AS (SELECT *, substr(role, 1, 1) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY p) > 1 AS again,
                     NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
                     NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS cut FROM placed),
     pairs AS (SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY p) || i AS pair FROM seen),
     told AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                     count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
                     count(*) FILTER (NOT blank AND NOT again AND cut) AS truncated,
                     count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
                     list({{'r': role, 't': text, 'i': i, 'm': blank OR again, 'x': cut, 's': NULL}} ORDER BY p) AS rows
              FROM pairs GROUP BY conv_id),
     started AS (SELECT * EXCLUDE (rows), list_prepend({{'r': '', 't': '', 'i': '', 'm': false, 'x': false, 's': {begin}}}, rows) AS rows FROM told),
     walked AS (SELECT * EXCLUDE (rows), list_reduce(rows, lambda acc, x:
                  {{'r': '', 't': '', 'i': '', 'm': false, 'x': false, 's': {inserted("[" + step + "]")}}}).s AS s FROM started),
     best AS (SELECT *, list_min([s[1], s[4]]) AS b FROM walked)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit,
       sha256(coalesce(substr(b.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id"""


SQL["op11_conversation_repair"] = _repair_sql()

# every order of the filters applied to counts by mask, without the walk over subsets
SQL["op12_filter_audit"] = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, {_WORDS.format(text="coalesce(text, '')")} AS ws FROM documents),
     own AS (SELECT t, min(doc_id) AS o FROM d GROUP BY t),
     f AS (SELECT part,
                  CAST(len(ws) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(ws)) < 80 * len(ws) AS INT)
                  + 4 * CAST(100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 10 * length(d.t) AS INT)
                  + 8 * CAST(regexp_matches(d.t, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(o < d.doc_id, false) AS INT) AS m,
                  coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic
           FROM d JOIN own ON d.t = own.t
           LEFT JOIN (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY 1) l
           ON d.doc_id = l.doc_id),
     cell AS (SELECT part, m, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, m),
     letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
     orders AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM letter a, letter b, letter c, letter d, letter e
                WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
     step AS (SELECT filter_order, i AS step, 1 << (ascii(substr(filter_order, i, 1)) - 65) AS bit,
                     coalesce(list_sum([1 << (ascii(substr(filter_order, j, 1)) - 65) for j in range(1, i)]), 0)::INT AS before
              FROM orders, range(1, 6) r(i)),
     found AS (SELECT part, filter_order, step, bit,
                      sum(CASE WHEN m & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
                      sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN n ELSE 0 END) AS removed,
                      sum(CASE WHEN m & before <> 0 AND m & bit <> 0 THEN n ELSE 0 END) AS redundant,
                      sum(CASE WHEN m = bit THEN n ELSE 0 END) AS unique_fails,
                      sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN good ELSE 0 END) AS good_lost,
                      sum(CASE WHEN m & before = 0 AND m & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
               FROM cell, step GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM found"""
