"""Removal of repeated word sequences by a compacted de Bruijn graph.

Runs of `width` words are the edges of the graph. Each edge has an anchor, the short run in it with the
smallest hash, so equal edges have equal anchors. Neighbouring edges of a text with the same anchor
cannot branch unless the anchor stands in other surroundings elsewhere; they travel as one path.

0. Texts of the same words are one class; its first document stands for it in all that follows, and the others lose all
   their words. Texts are not moved for that, only their digests.
1. Anchors that only one document has are left out: their edges do not repeat. The shared ones are a Bloom filter
   that grows with their number up to 32 MB; when it fills up, more paths pass, and the result stays the same.
2. Paths are aggregated to their first document and place (the source) and joined back: a path that an
   earlier document has too is removed as a whole.
3. Where an anchor has several different paths (the graph branches), the first copy of each path is
   split into its edges, and the edges are aggregated and joined in the same way.
4. Every match is checked against a second hash at its source; matches that continue each other at
   the same distance from their source are joined to long spans before they meet the text, and spans are cut from it.

Cases: null and empty texts have no words; a text shorter than `width` keeps all of them. A null id is
smaller than no id, so its row neither loses words nor is a source. Equal ids are not smaller than
each other; rows of one id are taken to hold one text. An empty table gives no rows. Other
columns are kept out of the result.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsubo.llm.common import Windows, mix, stored, text_bytes, words_of

WIDTH = 13
ANCHOR = 7
CHUNK = 1 << 18  # bytes hashed together
FILTER_BITS = 26
LEAST_BITS, MOST_BITS = 20, 28  # of a filter that grows with the number of its values
_VALUE = 48  # bits of a value that a filter reads: its first place is read from the lowest, its second from the highest ones
_LOW = np.uint64((1 << 48) - 1)
_SALT = np.uint64(0xA24BAED4963EE407)


class _Chunk:
    """The paths of some texts, laid back to back: runs of edges with one anchor place, none across two texts."""

    def __init__(self, ids: list, texts: list[bytes], width: int, anchor: int):
        self.width = width
        self.own, lengths = words_of(texts)
        self.windows = Windows(self.own)
        ends = np.cumsum(lengths)
        text = np.repeat(np.arange(len(texts)), lengths)
        short = self.windows.every(anchor)
        span = width - anchor + 1
        least, have = short, 1  # smallest of `have` short runs from a place on
        while have < span and len(least):
            step = min(have, span - have)
            least = np.minimum(least[:-step], least[step:])
            have += step
        n = len(least)
        whole = np.arange(n) + width <= ends[text[:n]]  # places whose edge lies in one text
        new = np.ones(n, bool)
        # the leftmost smallest run stays the same place unless its value changes or it was the first one
        if n:  # texts of fewer words than an edge have none
            new[1:] = (least[1:] != least[:-1]) | (short[:n - 1] == least[:-1]) | (whole[1:] != whole[:-1]) | (text[1:n] != text[:n - 1])
        first = np.flatnonzero(new)
        kept = whole[first]
        self.edges = np.diff(np.r_[first, n])[kept]
        self.first = first[kept]
        self.anchors = least[self.first] & _LOW
        self.text = text[self.first]
        self.starts = (ends - lengths)[self.text]
        self.ids = np.array(ids, np.int64)[self.text]

    @functools.cached_property
    def second(self) -> Windows:
        return Windows(mix(self.own ^ _SALT))

    def edge(self, places: np.ndarray) -> np.ndarray:
        return self.windows.at(places, self.width)

    def check(self, places: np.ndarray) -> np.ndarray:
        return self.second.at(places, self.width)

    def of(self, edge, k: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Hashes of the paths k: a path is shorter than two edges, so its first and last edge are all of it."""
        first, n = self.first[k], self.edges[k]
        return mix(mix(edge(first)) ^ (edge(first + n - 1) + n.astype(np.uint64)))


def _chunks(ids, texts: list[bytes], width: int, anchor: int):
    """Whole texts in chunks of about CHUNK bytes; a longer text is a chunk of its own."""
    some, held, size = [], [], 0
    for doc_id, text in zip(ids, texts):
        some.append(doc_id)
        held.append(text)
        size += len(text)
        if size >= CHUNK:
            yield _Chunk(some, held, width, anchor)
            some, held, size = [], [], 0
    if some:
        yield _Chunk(some, held, width, anchor)


class Stay:
    """The documents whose texts are looked at: by their keys, in a Bloom filter, or all. It may let others pass."""

    def __init__(self, docs: DataFrame, ids: DataFrame | None = None):
        keys = None if ids is None else ids.select(_key())
        self.filled = None if keys is None else docs.sparkSession.sparkContext.broadcast(bloom(keys, "key", filter_bits(keys.count())))

    def has(self, keys) -> np.ndarray:
        return np.ones(len(keys), bool) if self.filled is None else in_bloom(self.filled.value, keys.to_numpy().view(np.uint64))

    def of(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        """Rows of a batch with a column `key` that stay."""
        return batch if self.filled is None else batch.filter(pa.array(self.has(batch.column("key"))))


def _key():
    return F.xxhash64(F.col("doc_id").cast("bigint")).alias("key")


def _texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text, key) of rows that have an id."""
    return docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes("text").alias("text"), _key())


def copies(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_words) of the rows whose words are all those of a document with a smaller id, and the doc_id of the others.

    Texts of less than `width` words lose nothing, so they are among the others.
    """
    def run(batches):
        for batch in batches:
            texts = [text.split() for text in batch.column("text").to_pylist()]
            digests = [hashlib.sha256(b" ".join(words)).digest() if len(words) >= width else None for words in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(map(len, texts), pa.int64())],
                                             names=["doc_id", "digest", "n_words"])

    signed = stored(_texts(docs).mapInArrow(run, "doc_id bigint, digest binary, n_words bigint"), "repeat-digests")
    classes = stored(signed.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last")), "repeat-classes")
    later = signed.join(classes.where("last > first"), "digest").where("doc_id > first").select("doc_id", "n_words")
    others = classes.select(F.col("first").alias("doc_id")).unionByName(signed.where("digest IS NULL").select("doc_id"))
    return later, others


def shared_anchors(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, stay: Stay | None = None) -> DataFrame:
    """Anchors (hashes) that more than one document has."""
    stay = stay or Stay(docs)

    def run(batches):
        for batch in batches:
            found = []
            texts = stay.of(batch).column("text").to_pylist()
            for chunk in _chunks(range(len(texts)), texts, width, anchor):
                order = np.argsort(chunk.anchors, kind="stable")  # equal anchors stay in the order of the texts
                value, text = chunk.anchors[order], chunk.text[order]
                new = np.ones(len(value), bool)
                new[1:] = (value[1:] != value[:-1]) | (text[1:] != text[:-1])
                found.append(value[new])
            values = np.concatenate(found).view(np.int64) if found else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values)], names=["anchor"])

    rows = _texts(docs).mapInArrow(run, "anchor bigint")
    return rows.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")


def filter_bits(n: int) -> int:
    """The size of a filter for n values: a sixteenth of its bits are set at most, as long as MOST_BITS are enough for that."""
    return min(max((32 * n).bit_length(), LEAST_BITS), MOST_BITS)


def bloom(values: DataFrame, column: str, bits: int = FILTER_BITS) -> np.ndarray:
    """A Bloom filter with two bits per value, as uint64 words; 2^bits bits whatever the input."""
    mask = F.lit((1 << bits) - 1)
    places = values.select(F.explode(F.array(
        F.col(column).bitwiseAND(mask), F.shiftrightunsigned(column, _VALUE - bits).bitwiseAND(mask))).alias("p"))
    words = places.groupBy(F.shiftrightunsigned("p", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("v"))
    table = np.zeros(1 << (bits - 6), np.uint64)
    for part in words.toArrow().to_batches():  # at most 2^(bits - 6) rows
        table[part.column(0).to_numpy()] = part.column(1).to_numpy().view(np.uint64)
    return table


def in_bloom(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    bits = len(table).bit_length() + 5  # the table has 2^(bits - 6) words
    mask, found = np.uint64((1 << bits) - 1), np.ones(len(hashes), bool)
    for p in (hashes & mask, (hashes >> np.uint64(_VALUE - bits)) & mask):
        found &= (table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return found


def _batch(columns: list[list[np.ndarray]], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(c).astype(t) if c else np.empty(0, t)) for c, t in zip(columns, kinds)], names=names)


def paths(docs: DataFrame, shared: np.ndarray, width: int = WIDTH, anchor: int = ANCHOR, stay: Stay | None = None) -> DataFrame:
    """(anchor, path, check, doc_id, place, edges) of paths whose anchor is shared."""
    filled, stay = docs.sparkSession.sparkContext.broadcast(shared), stay or Stay(docs)
    names = ["anchor", "path", "check", "doc_id", "place", "edges"]

    def run(batches):
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            batch = stay.of(batch)
            for chunk in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), width, anchor):
                k = np.flatnonzero(in_bloom(filled.value, chunk.anchors))
                row = (chunk.anchors[k], chunk.of(chunk.edge, k), chunk.of(chunk.check, k) >> np.uint64(33),
                       chunk.ids[k], chunk.first[k] - chunk.starts[k], chunk.edges[k])
                for column, values in zip(out, row):
                    column.append(values)
            yield _batch(out, names, [np.int64, np.int64, np.int32, np.int64, np.int32, np.int32])

    return _texts(docs).mapInArrow(
        run, "anchor bigint, path bigint, check int, doc_id bigint, place int, edges int")


def _occurrence(path: np.ndarray, doc_id) -> np.ndarray:
    """A 48-bit key of a path in a document, or of the document for path 0."""
    with np.errstate(over="ignore"):
        return mix(path ^ mix(np.asarray(doc_id).astype(np.int64).view(np.uint64))) & _LOW


def branching_edges(docs: DataFrame, firsts: DataFrame, width: int = WIDTH, anchor: int = ANCHOR) -> DataFrame:
    """(path, check, doc_id, place, edges = 1): the single edges of the paths in firsts(path, doc_id)."""
    def keys(batches):
        for batch in batches:
            path, doc_id = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            found = np.concatenate([_occurrence(path, doc_id), np.unique(_occurrence(np.zeros_like(path), doc_id))])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["key"])

    wanted = stored(firsts.select("path", "doc_id").mapInArrow(keys, "key bigint").distinct(), "repeat-wanted")
    filled = docs.sparkSession.sparkContext.broadcast(bloom(wanted, "key", filter_bits(wanted.count())))
    names = ["path", "check", "doc_id", "place", "edges"]

    def run(batches):
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in names]
            ids = batch.column(0).to_numpy()
            batch = batch.filter(pa.array(in_bloom(filled.value, _occurrence(np.zeros(len(ids), np.uint64), ids))))
            for chunk in _chunks(batch.column(0).to_pylist(), batch.column(1).to_pylist(), width, anchor):
                k = np.flatnonzero(in_bloom(filled.value, _occurrence(chunk.of(chunk.edge), chunk.ids)))
                n = chunk.edges[k]
                at = np.repeat(chunk.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())  # every place of these paths
                row = (chunk.edge(at), chunk.check(at) >> np.uint64(33), np.repeat(chunk.ids[k], n),
                       at - np.repeat(chunk.starts[k], n), np.ones(len(at)))
                for column, values in zip(out, row):
                    column.append(values)
            yield _batch(out, names, [np.int64, np.int32, np.int64, np.int32, np.int32])

    return _texts(docs).mapInArrow(
        run, "path bigint, check int, doc_id bigint, place int, edges int")


def sources(rows: DataFrame, *keys: str) -> DataFrame:
    """The first document of each path, one of its places there, its second hash, and the last document."""
    at = F.shiftleft(F.col("place").cast("bigint"), 32).bitwiseOR(F.col("check").cast("bigint"))  # one value; check has 31 bits
    return rows.groupBy(*keys, "path").agg(
        F.min("doc_id").alias("source"), F.max("doc_id").alias("last"), F.min_by(at, "doc_id").alias("_at")).select(
        *keys, "path", "source", "last", F.shiftright("_at", 32).cast("int").alias("source_place"),
        F.col("_at").bitwiseAND((1 << 32) - 1).cast("int").alias("source_check"))


def matches(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, place, edges, source, source_place) of paths that an earlier document has too."""
    repeated = found.where("last > source").select("path", "source", "source_place", "source_check")
    return rows.select("path", "check", "doc_id", "place", "edges").join(repeated, "path").where(
        "doc_id > source AND check = source_check").select("doc_id", "place", "edges", "source", "source_place")


def spans(document: np.ndarray, place: np.ndarray, edges: np.ndarray, source: np.ndarray, source_place: np.ndarray,
          width: int) -> tuple[np.ndarray, ...]:
    """(document, first word, end, source, first word there) of the long repeats in matches of some documents: matches that
    continue each other, in the text and in the source. In the order of the documents."""
    place, source_place = place.astype(np.int64), source_place.astype(np.int64)
    ahead = place - source_place
    order = np.lexsort((place, ahead, source, document))
    document, place, source, source_place, ahead = (x[order] for x in (document, place, source, source_place, ahead))
    end = place + edges[order] - 1 + width
    other = np.ones(len(place), bool)  # another document, source or distance than the match before
    other[1:] = (document[1:] != document[:-1]) | (source[1:] != source[:-1]) | (ahead[1:] != ahead[:-1])
    lane = np.cumsum(other) << 32  # keeps the farthest end so far apart from that of others
    far = np.maximum.accumulate(lane + end) - lane
    new = other.copy()
    new[1:] |= place[1:] > far[:-1] - width + 1
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(place)] - 1
    return document[first], place[first], far[last[:len(first)]], source[first], source_place[first]


def repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, stay: Stay | None = None) -> DataFrame:
    """doc_id with its long repeats, an array of (first, end, source, source_first)."""
    shared = stored(shared_anchors(docs, width, anchor, stay), "repeat-anchors")
    rows = stored(paths(docs, bloom(shared, "anchor", filter_bits(shared.count())), width, anchor, stay), "repeat-paths")
    found = stored(sources(rows, "anchor"), "repeat-sources")
    branching = found.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    firsts = found.join(branching, "anchor", "left_semi").select("path", F.col("source").alias("doc_id"))
    edges = stored(branching_edges(docs, firsts, width, anchor), "repeat-edges")
    every = matches(rows, found).unionByName(matches(edges, sources(edges)))
    listed = every.groupBy("doc_id").agg(F.collect_list(F.struct("place", "edges", "source", "source_place")).alias("found"))

    def join(batches):
        for batch in batches:
            found = batch.column("found")
            parts = [x.to_numpy(zero_copy_only=False) for x in found.flatten().flatten()]
            sizes = found.value_lengths().to_numpy(zero_copy_only=False)
            document, *columns = spans(np.repeat(np.arange(len(sizes)), sizes), *parts, width)
            names, kinds = ["first", "end", "source", "source_first"], [pa.int32(), pa.int32(), pa.int64(), pa.int32()]
            values = pa.StructArray.from_arrays([pa.array(c.astype(k.to_pandas_dtype()), k) for c, k in zip(columns, kinds)], names=names)
            offsets = pa.array(np.searchsorted(document, np.arange(len(sizes) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "found"])

    return listed.mapInArrow(join, "doc_id bigint, found array<struct<first:int,end:int,source:bigint,source_first:int>>")


def without_repeats(docs: DataFrame, width: int = WIDTH, anchor: int = ANCHOR, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if asked for, the kept text.

    Only the texts of documents with repeats are shuffled, to meet their spans; those of whole copies are not.
    """
    later, others = copies(docs, width)
    later = stored(later, "repeat-copies")
    stay = Stay(docs, None if later.isEmpty() else others)
    found = stored(repeats(docs, width, anchor, stay), "repeat-matches")
    keys = found.select(_key())
    filled = docs.sparkSession.sparkContext.broadcast(bloom(keys, "key", filter_bits(keys.count())))
    kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                      *([("text", pa.string())] if with_text else [])])

    def cut(doc_id, text: bytes, firsts=None, ends=None):
        words = text.split()
        kept = words
        if firsts:
            gone = np.zeros(len(words) + 1, np.int32)
            for first, end in zip(firsts, ends):
                gone[min(first, len(words))] += 1
                gone[min(end, len(words))] -= 1
            kept = [w for w, g in zip(words, np.cumsum(gone)[:-1].tolist()) if not g]
        joined = b" ".join(kept)
        return doc_id, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()

    def as_batch(rows):
        columns = list(zip(*rows))[:len(kind)] if rows else [[] for _ in kind]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], schema=kind)

    def staying(batch):
        """Rows that are looked at here, and whether they may have repeats. Those without an id stay."""
        batch = batch.filter(pa.array(stay.has(batch.column("key")) | batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)))
        return batch, in_bloom(filled.value, batch.column("key").to_numpy().view(np.uint64))

    def plain(batches):
        for batch in batches:
            batch, may_repeat = staying(batch)
            some = batch.filter(pa.array(~may_repeat))
            yield as_batch([cut(d, t) for d, t in zip(some.column("doc_id").to_pylist(), some.column("text").to_pylist())])

    def repeating(batches):
        for batch in batches:
            batch, may_repeat = staying(batch)
            yield batch.filter(pa.array(may_repeat)).select(["doc_id", "text"])

    def cut_all(batches):
        for batch in batches:
            yield as_batch([cut(*row) for row in zip(*(batch.column(i).to_pylist() for i in range(4)))])

    def whole(batches):
        for batch in batches:
            batch = batch.filter(pa.array(~stay.has(batch.column("key"))))  # the others were looked at
            nothing = cut(None, b"")[3:]
            yield as_batch([(d, n, n, *nothing) for d, n in zip(batch.column("doc_id").to_pylist(), batch.column("n_words").to_pylist())])

    names = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", text string" if with_text else "")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes("text").alias("text"), _key())
    places = found.select("doc_id", F.col("found.first").alias("firsts"), F.col("found.end").alias("ends"))
    joined = rows.mapInArrow(repeating, "doc_id bigint, text binary").join(places, "doc_id", "left").select("doc_id", "text", "firsts", "ends")
    return rows.mapInArrow(plain, names).unionByName(joined.mapInArrow(cut_all, names)).unionByName(
        later.select("doc_id", "n_words", _key()).mapInArrow(whole, names))
