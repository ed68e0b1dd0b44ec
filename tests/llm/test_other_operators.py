"""URL filter, vectors, archives, the pipeline and the registration."""

import hashlib
import importlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.data import DOC, documents, grouped, jaccard_groups
from tsubo.llm import epsilon, pii, queries, urlfilter, warc
from tsubo.llm.common import stored

PAGE = "page_id bigint, url string, html string, host string, verdict string, n int"


# ------------------------------------------------------------------ URL filter
def plain_rule(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
        rest = rest[end:]
        path = rest[:min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    best = None
    for rule, verdict in urlfilter.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, best


def test_rules_and_parts_of_urls(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.com/en/1", "https://www.example.com/en/", "http://a.example.com/en", "x://net/es/?q=/",
            "http://a.net/fr/x#y", "http://net", "http://b.net?x=/fr/", "http://É.com/", "http://notcom/", "http://x.com/a\nb?c", "http://a.com#/en/",
            "http://u:p@h.com:80/en/://x", "ftp://example.com/en/x.html"]
    pages = spark.createDataFrame([(i, u, "h", "x", "y", 1) for i, u in enumerate(urls)], PAGE)
    found = {r["page_id"]: r for r in urlfilter.judged(pages, spark.createDataFrame([], "page_id bigint, bad int")).collect()}
    for i, url in enumerate(urls):
        host, path, rule = plain_rule(url)
        r = found[i]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule[0] if rule else None), url
        assert r["verdict"] == (rule[1] if rule else "allow")


def test_templates_learn_bad_sections(spark):
    rows, labels = [], []
    for i in range(600):
        section = ["news", "adult", "shop"][i % 3]
        rows.append((i, f"http://h.org/{section}/{i}.html", None, "", "", 0))
        if i % 2:
            labels.append((i, int(section == "adult")))
    rows += [(None, "http://h.org/adult/x", None, "", "", 0), (1, "http://h.org/adult/1.html", None, "", "", 0)]
    pages, marks = spark.createDataFrame(rows, PAGE), spark.createDataFrame([*labels, (1, 0), (None, 1), (2, None)], "page_id bigint, bad int")
    found = urlfilter.judged(pages, marks).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r["verdict"] == ("block" if "/adult/" in r["path"] else "allow")
    assert {r["template"] for r in found if "/news/" in r["path"]} == {"/news/<num>.html"}
    branches = {r["template"]: r["branch"] for r in found}
    assert branches["/adult/<num>.html"] == "/adult/~"  # no sibling differs below a section


def test_similar_branches_merge(spark):
    templates = [("h", "/a/x", 100, 100, 2), ("h", "/a/y", 100, 100, 3), ("h", "/a/z", 100, 100, 90), ("h", "/a/n", 5, 0, 0)]
    df = spark.createDataFrame(templates, "host string, template string, pages bigint, labelled bigint, bad bigint")
    found = {r["template"]: r["branch"] for r in urlfilter.merged_branches(df).collect()}
    assert found["/a/x"] == found["/a/y"] == found["/a/n"] != found["/a/z"] == "/a/z"
    only = df.where("template <> '/a/z'")
    assert {r["branch"] for r in urlfilter.merged_branches(only).collect()} == {"/a/~"}


def test_like_siblings_merge_beside_others(spark):
    templates = [("h", "/a/x", 100, 100, 2), ("h", "/a/y", 100, 100, 3), ("h", "/a/z", 100, 100, 90), ("h", "/a/n", 5, 0, 0),
                 *[("g", f"/{i}", 6, 6, 6) for i in range(5)], ("g", "/big", 500, 500, 5),
                 # alike as wholes, not below
                 ("k", "/a/x", 50, 50, 50), ("k", "/a/y", 50, 50, 0), ("k", "/b/x", 50, 50, 0), ("k", "/b/y", 50, 50, 50), ("k", "", 1, 1, 0),
                 # equal names of unlike branches below merged ones
                 ("m", "/a/x", 200, 200, 0), ("m", "/a/y", 200, 200, 100), ("m", "/b/x", 400, 400, 100), ("m", "/~2", 9, 9, 9)]
    df = spark.createDataFrame(templates, "host string, template string, pages bigint, labelled bigint, bad bigint")
    found = {(r["host"], r["template"]): r["branch"] for r in urlfilter.merged_branches(df).collect()}
    assert len(found) == len(templates)
    assert found["h", "/a/x"] == found["h", "/a/y"] == found["h", "/a/n"] != found["h", "/a/z"]
    assert len({found["g", f"/{i}"] for i in range(5)}) == 1 and found["g", "/0"] != found["g", "/big"]
    assert len({found["m", t] for t in ("/a/x", "/a/y", "/b/x", "/~2")}) == 4
    assert found["k", "/a/x"] == found["k", "/b/y"] != found["k", "/a/y"] == found["k", "/b/x"]


def test_like_inner_branches_merge(spark):
    """Twelve bad sections with seven labels each are bad together."""
    rows = [(i, f"http://bad.org/a{i % 12}/{i}", None, "", "", 0) for i in range(84)]
    rows += [(i, f"http://good{i % 8}.org/{i}", None, "", "", 0) for i in range(84, 840)]
    labels = spark.createDataFrame([(r[0], int(r[0] < 84)) for r in rows], "page_id bigint, bad int")
    for r in urlfilter.judged(spark.createDataFrame(rows, PAGE), labels).collect():
        assert r["verdict"] == ("block" if r["host"] == "bad.org" else "allow")


def test_templates_do_not_depend_on_repeats_or_deeper_pages(spark):
    paths = [f"/user/{i}x/{j}" for i in range(60) for j in range(7)]  # more than five pages per id
    paths += [f"/s{i}/{j}.html" for i in range(12) for j in range(70)] + [f"/one{i}" for i in range(9)]
    once = spark.createDataFrame([("h", p, i, int(p.startswith("/s3/"))) for i, p in enumerate(paths)], "host string, path string, page_id int, bad int")
    again = once.crossJoin(spark.range(6).select(F.col("id").alias("n")))
    found = {(r["path"], r["template"]) for r in urlfilter.template_tree(once).collect()}
    repeated = urlfilter.template_tree(again).collect()
    assert len(repeated) == 6 * len(paths) and {(r["path"], r["template"]) for r in repeated} == found
    assert {t for p, t in found if p.startswith("/user/")} == {"/user/<any>/" + str(j) for j in range(7)}
    assert {t for p, t in found if p.startswith("/s")} == {f"/s{i}/<num>.html" for i in range(12)}
    assert {t for p, t in found if p.startswith("/one")} == {"/<any>"}


def test_a_rare_value_with_clear_labels_stays_a_branch(spark):
    rows = [("h", f"/s{i}/{i * 20 + j}", int(i == 7)) for i in range(50) for j in range(20)]
    found = urlfilter.template_tree(spark.createDataFrame(rows, "host string, path string, bad int")).collect()
    assert {r["template"] for r in found} == {"/s7/<num>", "/<any>/<num>"}


def test_deep_paths_are_told_apart(spark):
    rows = [(i, f"http://h.org/2024/05/12/city/{'adult' if i % 2 else 'news'}/x/{i}", None, "", "", 0) for i in range(100)]
    rows += [(100, "http://h.org/" + "d/" * 60 + "end", None, "", "", 0), (101, "http://h.org/2024/05/12/city", None, "", "", 0)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "page_id bigint, bad int")
    found = {r["page_id"]: r for r in urlfilter.judged(spark.createDataFrame(rows, PAGE), labels).collect()}
    assert all(found[i]["verdict"] == ("block" if i % 2 else "allow") for i in range(100))
    assert found[1]["template"] == "/2024/05/12/city/adult/x/<num>"
    assert found[100]["template"] == found[100]["path"] and found[101]["template"] == "/2024/05/12/city"


def test_url_filter_runs_no_python_and_takes_nothing(spark):
    none = spark.createDataFrame([], PAGE)
    marks = spark.createDataFrame([], "page_id bigint, bad int")
    found = urlfilter.judged(none, marks)
    assert found.collect() == []
    assert not any(x in found._jdf.queryExecution().toString() for x in ("Python", "Arrow", "Pandas"))


# ------------------------------------------------------------------ vectors
def brute_force(vectors, least=0.95):
    def unit(v):
        v = np.array(v, float) / np.abs(np.array(v, float)).max()
        return v / np.linalg.norm(v)

    x = {i: unit(v) for i, v in vectors if v is not None
         and not any(c is None for c in v) and np.isfinite(np.array(v, float)).all() and any(v)}
    links = [(a, b) for a in x for b in x if a < b and len(x[a]) == len(x[b]) and x[a] @ x[b] >= least]
    parts = grouped(links, [i for i, _ in vectors])
    return {i: (sum(i in pair for pair in links), parts[i], parts[i] == i) for i, _ in vectors}


@pytest.mark.parametrize("block", [4, 1024])
def test_vectors_against_brute_force(spark, block):
    rng = np.random.default_rng(4)
    vectors = []
    for c in range(12):
        centre = rng.normal(size=8)
        for _ in range(rng.integers(1, 12)):
            vectors.append((centre + rng.normal(size=8) * 0.12).tolist())
    same = rng.normal(size=8).tolist()
    vectors += [same] * 20 + [[0.0] * 8, None, [1.0, None] + [0.0] * 6, [float("nan")] * 8, [float("inf")] + [1.0] * 7, [1.0, 2.0], [], [1e-200] * 8, [1e200] * 8]
    ids = rng.permutation(len(vectors)).tolist()
    rows = [(i * 10, v) for i, v in zip(ids, vectors)]
    df = stored(spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id bigint, embedding array<double>, label int, cell string").repartition(4), "t")
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in epsilon.near_duplicates(df, block=block, fanout=2).collect()}
    assert found == brute_force(rows)


@pytest.mark.parametrize("block", [3, 1024])
def test_vectors_of_several_lengths(spark, block):
    """Every length has its links, also one that the sample of directions does not hold."""
    rng = np.random.default_rng(5)
    vectors = [[1.0, 0.0], [1.0, 0.0], [2.0, 0.1], [0.0, 1.0]]
    for width in (1, 3, 9):
        for _ in range(6):
            centre = rng.normal(size=width)
            vectors += [(centre + rng.normal(size=width) * 0.1).tolist() for _ in range(3)]
    rows = list(enumerate(vectors))
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for sample in (5, 4096):
        found = epsilon.near_duplicates(df, block=block, fanout=2, sample=sample).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found} == brute_force(rows)
    assert brute_force(rows)[1][1] == 0 and brute_force(rows)[2][0] == 2


def test_vectors_of_nothing(spark):
    kind = "vec_id bigint, embedding array<float>"
    assert epsilon.near_duplicates(spark.createDataFrame([], kind)).collect() == []
    found = epsilon.near_duplicates(spark.createDataFrame([(1, None), (2, [0.0, 0.0])], kind)).collect()
    assert {tuple(r) for r in found} == {(1, 0, 1, True), (2, 0, 2, True)}


# ------------------------------------------------------------------ archives
def captures(spark, rows):
    df = spark.createDataFrame(rows, "page_id bigint, url string, payload string, x int")
    return df.withColumn("capture_time", F.date_format(F.timestamp_seconds(F.col("page_id") % 50 + 1_600_000_000), "yyyyMMddHHmmss"))


def test_archives_round_trip(spark, tmp_path):
    rng = random.Random(9)
    long, rows = "é" * 600, []
    for i in range(300):
        payload = [None, "", "short", long, f"page {i} " * 200, "x" * 1000, "x" * 999, "\r\n\r\nWARC/1.1\r\n" * 90][rng.randrange(8)]
        rows.append((i, [None, "bad", f"https://www.b{i % 3}.example.com/P/{i % 7}?q#f", "http://host.org\r\nx"][i % 4], payload, 1))
    found = {r["page_id"]: r for r in warc.archive_round_trip(captures(spark, rows).repartition(5), range_rows=20).collect()}
    assert len({r["history_range"] for r in found.values()}) > 8 and found.keys() == {r[0] for r in rows}
    last: dict = {}
    for i, _, payload, _ in rows:
        data = (payload or "").encode()
        if len(data) >= 1000:
            last[data] = max(last.get(data, -1), i)
    for i, _, payload, _ in rows:
        data = (payload or "").encode()
        again = data in last and i < last[data]
        r = found[i]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", last[data]) if again else ("response", None))
    ordered = sorted(found.values(), key=lambda r: r["history_position"])
    assert [r["history_position"] for r in ordered] == list(range(len(rows)))
    assert ordered == sorted(ordered, key=lambda r: (r["history_range"], r["history_place"]))
    keys = [(r["url_key"], r["capture_time"], r["page_id"]) for r in ordered]
    assert keys == sorted(keys) and len(set((r["history_range"], r["history_place"]) for r in ordered)) == len(rows)


def test_archive_files_are_gzip_members(spark, tmp_path):
    rows = warc.with_revisits(captures(spark, [(1, "http://a.b/c", "hello", 0)]))
    entry = warc.write_archives(rows.coalesce(1), str(tmp_path)).collect()[0]
    data = (tmp_path / entry["file"]).read_bytes()[entry["offset"]:entry["offset"] + entry["length"]]
    text = zlib.decompress(data, 31)
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and text.endswith(b"\r\n\r\nhello\r\n\r\n")
    assert entry["url_key"] == "b,a)/c"


def test_small_archives_roll_over_and_runs_are_sorted(spark, tmp_path):
    rows = warc.with_revisits(captures(spark, [(i, f"http://h{i * 7 % 10}.org/", "p" * i, 0) for i in range(40)]))
    index = stored(warc.write_archives(rows.coalesce(1), str(tmp_path), archive_bytes=2000), "t")
    runs: dict = {}
    for r in index.collect():
        runs.setdefault(r["run"], []).append((r["url_key"], r["capture_time"]))
    assert len(runs) > 3 and all(len(v) < 40 for v in runs.values())
    assert len(list(tmp_path.iterdir())) == len(runs)
    assert warc.read_archives(index, str(tmp_path)).count() == 40


@pytest.mark.parametrize("runs", [[], [[]], [[1, 3], [2], [], [0, 9, 9]], [[5], [5], [5]]])
def test_loser_tree(runs):
    assert list(warc.LoserTree(runs, key=lambda x: (x,))) == sorted(sum(runs, []))


def test_archives_of_nothing_and_null_ids(spark):
    assert warc.archive_round_trip(captures(spark, [(1, "u", "p", 0)]).where("false")).collect() == []
    rows = [(None, None, "z" * 2000, 0), (None, "http://a/", "z" * 2000, 0), (4, "http://a/", "z" * 2000, 0), (4, "http://a/", "z" * 2000, 0)]
    found = sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in warc.archive_round_trip(captures(spark, rows)).collect())
    assert found == [(0, "revisit", 4), (0, "revisit", 4), (4, "response", 0), (4, "response", 0)]


# ------------------------------------------------------------------ pipeline
@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


@pytest.fixture(scope="module")
def small(spark):
    return stored(spark.createDataFrame(documents(seed=8, n=12), DOC).repartition(2), "t")


def test_stages_keep_columns_and_take_effect(spark, pipeline, small):
    docs, names = small, list(pipeline.COLUMNS)
    assert [n for n, _ in pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mix", "pack"]

    kept = stored(pipeline.language(spark, docs, ""), "t")
    assert kept.columns == names
    letters = {r["doc_id"] for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")}
    assert {r["doc_id"] for r in kept.collect()} == letters

    unique = stored(pipeline.near_duplicates(spark, kept, ""), "t")
    groups = jaccard_groups([(r["doc_id"], r["text"]) for r in kept.collect()], 5, 80)
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted({c for _, c in groups.values()})
    assert unique.columns == names

    marked = unique.withColumn("text", F.concat("text", F.lit(" mail a.b@c.example.org"))).withColumn("n_chars", F.lit(0).cast("bigint"))
    clean = stored(pipeline.personal_data(spark, marked, ""), "t")
    before = {r["doc_id"]: r["text"] for r in marked.collect()}
    for r in clean.collect():
        assert r["text"].endswith(" mail <email>") and "@" not in r["text"] and r["n_chars"] == len(r["text"])
        assert pii.base_spans(before[r["doc_id"]])
    assert clean.columns == names

    mixed = stored(pipeline.mix(spark, clean, ""), "t")
    assert mixed.columns == names
    counts: dict = {}
    for r in mixed.collect():
        counts[r["doc_id"]] = counts.get(r["doc_id"], 0) + 1
    assert max(counts.values()) <= 3
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    total = words(clean.collect())
    assert abs(words(mixed.collect()) - total) <= 0.5 * 9000 * 6

    packed = pipeline.pack(spark, mixed, "").collect()
    assert sum(r["piece"] == 0 for r in packed) == mixed.count()
    used: dict = {}
    for r in packed:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in used.values():
        assert sum(n for _, n in parts) <= 4096


def test_stages_take_empty_tables(spark, pipeline):
    docs = spark.createDataFrame([], DOC)
    for _, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, ""), "t")
        assert docs.count() == 0


def test_near_duplicates_keep_null_ids_and_one_row_of_repeats(spark, pipeline):
    text = "some words that make up a longer text of their own"
    rows = [(None, text, "en", "s", 1), (None, text, "en", "s", 1), (5, text, "en", "s", 1), (5, text, "en", "s", 1), (2, text, "en", "s", 1), (7, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = sorted((r["doc_id"] or 0) for r in pipeline.near_duplicates(spark, df, "").collect())
    assert found == [0, 0, 2, 7]


# ------------------------------------------------------------------ registration
def test_every_operator_has_a_query():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    for n in range(1, 11):
        assert [q for q in names if q.startswith(f"op{n}_")], n
    assert "pipeline" in names and set(queries.SQL) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, folder, name):
    found = queries.QUERIES[name](spark, folder)
    con = duckdb.connect()
    for table in ("pages", "documents", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    rows = con.execute(f"SELECT {', '.join(found.columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(rows, key=repr)
