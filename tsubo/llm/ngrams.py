"""Exact Jaccard join of documents on word n-grams, by rare-first prefixes.

Every document is a set of distinct runs of `width` words. Equal sets are one class. A class's n-grams
are ordered rare first, by a frequency sketch of all documents (a table of fixed size that is summed over
all tasks). Two sets as similar as asked for share an n-gram among their first |x| - ceil(t |x|) + 1
(prefix filter); an n-gram that no two sets of fitting sizes share is left out. Sets that share one are compared
by size (length filter), by how many n-grams stand before the shared one in either (positional filter), by
how many of their prefixes they share with any set, and by one bit per hash range, odd or even number
of n-grams: sets differ in at least as many n-grams as bits (suffix filter). The pairs left are compared on their
whole prefixes, and what is left then is verified once per pair, on the whole sets.

Dense groups: first every set is verified only against the most ordinary set (fewest n-grams of its own)
among those that share an n-gram with it. That links large groups of copies with as many pairs as
members. Then only pairs of sets that are not yet in one component are looked at, so a group of near
copies does not turn into all its pairs. An n-gram that very many sets share is dealt out in blocks.

Cases: null, empty and blank texts have the empty set and link with nothing; fewer words than `width`
are one n-gram of all of them; equal sets link; a null id links with nothing and is its own null
component; rows that repeat an id are one node. An empty table gives no rows. Other columns are kept
out of the result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsubo.llm.common import Windows, components, stored, text_bytes, words_of
from tsubo.llm.substrings import bloom, in_bloom

WIDTH = 3
PERCENT = 90
SKETCH_BITS = 22
SKETCH_PARTS = 64
BLOCK = 256
PARTNERS = 64
CHUNK = 1 << 18  # bytes hashed together
RANGES = 2.56  # hash ranges by the square of the percent by which similar sets may differ: 256 at 90, 1024 at 80


def ranges_of(percent: int) -> int:
    """Number of hash ranges, a power of two from 64 on."""
    return 1 << min(10, max(6, round(float(np.log2(RANGES * max(1, 100 - percent) ** 2)))))


def shingles(texts: list[bytes], width: int):
    """For each text the sorted hashes of the distinct n-grams of its lower-cased (A-Z) words; hashed in chunks of whole texts."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < CHUNK:
            size += len(texts[end])
            end += 1
        words, lengths = words_of([text.lower() for text in texts[at:end]])
        windows = Windows(words)
        every = windows.every(width)
        start = 0
        for n in lengths.tolist():
            if n >= width:
                yield np.unique(every[start:start + n - width + 1])
            else:
                yield windows.at(np.full(min(n, 1), start), n)
            start += n
        at = end


def rarity(docs: DataFrame, width: int = WIDTH) -> np.ndarray:
    """A level per hash bucket (8 per doubling of its count), from the n-grams of all documents."""
    size, step = 1 << SKETCH_BITS, (1 << SKETCH_BITS) // SKETCH_PARTS

    def count(batches):
        total, waiting, n = np.zeros(size, np.uint32), [], 0
        mask = np.uint64(size - 1)

        def flush():
            np.add(total, np.bincount(np.concatenate(waiting), minlength=size).astype(np.uint32), out=total)

        for batch in batches:
            for found in shingles(batch.column(0).to_pylist(), width):
                waiting.append((found & mask).astype(np.int64))
                n += len(found)
                if n > 2_000_000:
                    flush()
                    waiting, n = [], 0
        if waiting:
            flush()
        for i in range(SKETCH_PARTS):
            part = total[i * step:(i + 1) * step]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([zlib.compress(part.tobytes(), 1)])], names=["part", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                values = np.frombuffer(zlib.decompress(counts), np.uint32)
                sums[part] = sums.get(part, np.zeros(step, np.uint64)) + values
        for part, values in sums.items():
            levels = np.minimum(np.round(8 * np.log2(values + 1.0)), 255).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([levels.tobytes()])], names=["part", "levels"])

    counted = docs.select(text_bytes("text")).mapInArrow(count, "part int, counts binary")
    table = np.zeros(size, np.uint8)
    for row in counted.repartition(SKETCH_PARTS, "part").mapInArrow(add, "part int, levels binary").toLocalIterator():
        table[row["part"] * step:(row["part"] + 1) * step] = np.frombuffer(row["levels"], np.uint8)  # 4 MB in all
    return table


def document_sets(docs: DataFrame, levels: np.ndarray, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, set_key, prefix (8-byte keys, rare first) and a bit per hash range (ranges)."""
    shared = docs.sparkSession.sparkContext.broadcast(levels)
    n_ranges = ranges_of(percent)
    shift = np.uint64(65 - n_ranges.bit_length())

    def run(batches):
        import xxhash

        mask = np.uint64((1 << SKETCH_BITS) - 1)
        for batch in batches:
            sizes, keys, prefixes, ranges = [], [], [], []
            for found in shingles(batch.column(1).to_pylist(), width):
                n = len(found)
                sizes.append(n)
                keys.append(xxhash.xxh3_128_digest(found.tobytes()) if n else None)
                level = shared.value[(found & mask).astype(np.int64)].astype(np.uint64)
                order = (level << np.uint64(56)) | (found >> np.uint64(8))
                first = n + (-percent * n) // 100 + 1
                if n and first < n:
                    order = np.partition(order, first - 1)[:first]
                order.sort()
                prefixes.append(order.tobytes())
                counts = np.bincount((found >> shift).astype(np.int64), minlength=n_ranges)
                ranges.append(np.packbits((counts & 1).astype(bool)).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(prefixes, pa.binary()),
                 pa.array(ranges, pa.binary())], names=["doc_id", "n_shingles", "set_key", "prefix", "ranges"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_bytes("text")).mapInArrow(
        run, "doc_id bigint, n_shingles bigint, set_key binary, prefix binary, ranges binary")


def _post(percent: int) -> str:
    """Columns of a posting row; its last ones hold 64 bits each."""
    words = [f"r{i} bigint" for i in range(ranges_of(percent) // 64)]
    return ", ".join(["token bigint, doc bigint, size int, place int, own int, first bigint, second bigint", *words])


def bands(sizes: np.ndarray, percent: int) -> np.ndarray:
    """A bit, one of 64 in turn, per range of sizes; sets as similar as asked for have the same or neighbouring ones."""
    wide = max(0.01, float(np.log(100 / max(1, percent)))) * (1 + 1e-9)  # the logarithms are rounded
    return np.left_shift(np.uint64(1), (np.log(np.maximum(sizes, 1)) / wide).astype(np.uint64) & np.uint64(63))


def _tokens(classes: DataFrame, percent: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            prefixes = batch.column(1).to_pylist()
            band = np.repeat(bands(batch.column(0).to_numpy(), percent).view(np.int64), [len(p) // 8 for p in prefixes])
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(prefixes), np.int64)), pa.array(band)], names=["token", "band"])

    return classes.select("n_shingles", "prefix").mapInArrow(run, "token bigint, band bigint")


def shared_tokens(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Prefix n-grams that two classes of the same or neighbouring bands have; with more classes than bands, two share a band."""
    seen = _tokens(classes, percent).groupBy("token").agg(F.count("*").alias("n"), F.bit_or("band").alias("seen"))
    return seen.where("n > bit_count(seen) OR (seen & (shiftleft(seen, 1) | shiftrightunsigned(seen, 63))) <> 0").select("token")


def postings(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """A row per class and prefix n-gram that other classes of a fitting size have too (or seem to, by the filter)."""
    filled = classes.sparkSession.sparkContext.broadcast(bloom(shared_tokens(classes, percent), "token"))  # 8 MB
    schema = _post(percent)

    def run(batches):
        for batch in batches:
            parts = []
            for doc, size, prefix, ranges in zip(*(batch.column(i).to_pylist() for i in range(4))):
                tokens = np.frombuffer(prefix, np.uint64)
                places = np.flatnonzero(in_bloom(filled.value, tokens))
                n = len(places)
                if n:
                    r = np.frombuffer(ranges, np.int64)
                    shared = tokens[places].view(np.int64)
                    parts.append((shared, np.full(n, doc), np.full(n, size, np.int32), places.astype(np.int32),
                                  np.full(n, len(tokens) - n, np.int32), np.full(n, shared[0]), np.full(n, shared[min(1, n - 1)]),
                                  *[np.full(n, x) for x in r]))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)],
                                                 names=[c.split()[0] for c in schema.split(", ")])

    return classes.select("rep", F.col("n_shingles").cast("int"), "prefix", "ranges").mapInArrow(run, schema)


class _Rows:
    """Posting rows of a batch as arrays."""

    def __init__(self, batch, extra: tuple[str, ...] = ()):
        get = lambda n: batch.column(n).to_numpy(zero_copy_only=False)
        self.doc, self.size, self.place, self.own = get("doc"), *(get(n).astype(np.int64) for n in ("size", "place", "own"))
        words = [n for n in batch.schema.names if n[0] == "r" and n[1:].isdigit()]
        self.ranges = np.stack([get(n) for n in words], axis=1).view(np.uint64)
        self.extra = {n: get(n) for n in extra}

    def near(self, i: np.ndarray, j: np.ndarray, percent: int) -> np.ndarray:
        """Which pairs may be similar enough: length, positional, shared prefix and suffix filters."""
        small, large = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        both = small + large
        common = -(-percent * both // (100 + percent))  # least n-grams in common
        apart = both - 2 * common  # most n-grams that one has and the other lacks
        # in common are at most what either shares of its prefix and what the set whose prefix ends first has behind it
        first = self.size + -percent * self.size // 100 + 1
        behind, shares = self.size - first + 1, first - self.own
        ok = (100 * small >= percent * large) & (self.place[i] + self.place[j] <= apart) & (self.doc[i] != self.doc[j])
        ok &= np.minimum(shares[i], shares[j]) + np.maximum(behind[i], behind[j]) >= common
        at = np.flatnonzero(ok)
        if len(at):
            distance = np.bitwise_count(self.ranges[i[at]] ^ self.ranges[j[at]]).sum(axis=1, dtype=np.int64)
            ok[at] = distance <= apart[at]
        return ok

    def seen(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs meet at an earlier n-gram too, as far as the first two of each tell."""
        token, first, second = (self.extra[n].view(np.uint64) for n in ("token", "first", "second"))
        out = np.zeros(len(i), bool)
        for a in (first[i], second[i]):
            for b in (first[j], second[j]):
                out |= (a == b) & (a < token[i])
        return out


def _whole_groups(batches, keys: tuple[str, ...]):
    """Record batches recut so that no group of equal keys is split (groups are contiguous and short)."""
    rest = None
    for batch in batches:
        if not len(batch):
            continue
        rest = batch if rest is None else pa.concat_batches([rest, batch])
        same = np.ones(len(rest), bool)
        for k in keys:
            column = rest.column(k).to_numpy(zero_copy_only=False)
            same &= column == column[-1]
        different = np.flatnonzero(~same)
        cut = int(different[-1]) + 1 if len(different) else 0
        if cut and len(rest) >= 4000:
            yield rest.slice(0, cut)
            rest = rest.slice(cut)
    if rest is not None and len(rest):
        yield rest


def _starts(batch, keys: tuple[str, ...]) -> np.ndarray:
    """Group number of each row."""
    new = np.zeros(len(batch), bool)
    for k in keys:
        column = batch.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= column[1:] != column[:-1]
    return np.cumsum(new)


def _among(rows: DataFrame, keys: DataFrame, column: str, name: str) -> DataFrame:
    """A flag per row: false only if its column is not among the keys. A filter of fixed size; no row is shuffled."""
    filled = rows.sparkSession.sparkContext.broadcast(bloom(keys.select(F.xxhash64(column).alias("key")), "key"))  # 8 MB

    @F.pandas_udf("boolean")
    def seems(key: pd.Series) -> pd.Series:
        return pd.Series(in_bloom(filled.value, key.to_numpy().view(np.uint64)))

    return rows.withColumn(name, seems(F.xxhash64(column)))


def star_pairs(rows: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b): a is the most ordinary class of an n-gram's block, b another one of it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = stored(rows.groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") > block).select(
        "token", F.ceil(F.col("n") / block).alias("blocks")), "ngram-hot")
    dealt = rows.join(heavy, "token", "left").withColumn(
        "lo", F.coalesce(F.pmod(F.xxhash64("doc"), F.col("blocks")), F.lit(0)).cast("int")).drop("blocks")
    keys = ("token", "lo")

    def run(batches):
        for batch in _whole_groups(batches, keys):
            group = _starts(batch, keys)
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])[group]
            data, i = _Rows(batch), np.arange(len(group))
            i, first = i[i != first], first[i != first]
            ok = data.near(first, i, percent)
            pairs = np.unique(np.stack([data.doc[first[ok]], data.doc[i[ok]]], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    found = dealt.repartition(parts, *keys).sortWithinPartitions(*keys, "own", "doc").mapInArrow(run, "a bigint, b bigint")
    # two classes that are each the other's centre somewhere are one pair
    return found.groupBy(F.least("a", "b"), F.greatest("a", "b")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")


def remaining_pairs(rows: DataFrame, parts_of: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b): classes of different components that share an n-gram and pass the filters."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = rows.join(parts_of.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    # an n-gram whose classes are all in one component has nothing more to tell; a hot one is known exactly
    tokens = marked.groupBy("token").agg(F.count("*").alias("n"), (F.min("component") != F.max("component")).alias("open")).where(
        F.col("open") | (F.col("n") > block))
    tokens = stored(tokens.select("token", "open", F.ceil(F.col("n") / block).cast("int").alias("blocks")), "ngram-open")
    open_rows = _among(marked, tokens.where("open"), "token", "maybe").join(tokens.where("blocks > 1"), "token", "left").where(
        F.coalesce("open", "maybe")).withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn(
        "own_block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int")).drop("open", "maybe")
    dealt = open_rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "*", F.least("own_block", "other").alias("lo"), F.greatest("own_block", "other").alias("hi")).drop("blocks", "other")
    keys = ("token", "lo", "hi")

    def run(batches):
        for batch in _whole_groups(batches, keys):
            group, data, found = _starts(batch, keys), _Rows(batch, ("component", "own_block", "lo", "hi", "token", "first", "second")), []
            part, own, within = data.extra["component"], data.extra["own_block"], data.extra["lo"] == data.extra["hi"]
            i = np.arange(len(group))
            for d in range(1, len(group)):
                i = i[:np.searchsorted(i, len(group) - d)]
                i = i[group[i + d] == group[i]]
                if not len(i):
                    break
                j = i + d
                new = (part[i] != part[j]) & (within[i] | (own[i] != own[j]))
                new[new] = ~data.seen(i[new], j[new])
                a, b = i[new], j[new]
                ok = data.near(a, b, percent)
                x, y = data.doc[a[ok]], data.doc[b[ok]]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return dealt.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, "a bigint, b bigint").distinct()


def _dealt(pairs: DataFrame, data: DataFrame, columns: list[str], partners: int) -> DataFrame:
    """Rows (a, part, b, columns of data): those of a (b is null) come before those of the b it is compared with.

    A class with very many pairs is dealt out in groups of about `partners` of them.
    """
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    many = pairs.groupBy("a").agg(F.count("*").alias("n")).where(F.col("n") > partners).select("a", F.ceil(F.col("n") / partners).alias("groups"))
    grouped = stored(pairs.join(many, "a", "left").select(
        "a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.col("groups")), F.lit(0)).alias("part")), "ngram-pairs")
    needed = grouped.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    found = stored(_among(data, needed, "doc", "needed").where("needed").drop("needed").join(needed, "doc", "left_semi"), "ngram-texts")
    left = grouped.select("a", "part").distinct().join(found.withColumnRenamed("doc", "a"), "a").select(
        "a", "part", F.lit(None).cast("bigint").alias("b"), *columns)
    right = grouped.join(found.withColumnRenamed("doc", "b"), "b").select("a", "part", "b", *columns)
    return left.unionByName(right).repartition(parts, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())


def _compared(dealt: DataFrame, values, similar) -> DataFrame:
    """The pairs (a, b) of dealt rows of which some of a's values (an id may repeat) is similar to one of b's."""
    def run(batches):
        mine, key = [], None
        for batch in batches:
            out = []
            for a, part, b, found in zip(*(batch.column(n).to_pylist() for n in ("a", "part", "b")), values(batch)):
                if b is None:
                    mine, key = [*mine, found] if key == (a, part) else [found], (a, part)
                elif any(similar(x, found) for x in mine):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64())], names=["a", "b"])

    return dealt.mapInArrow(run, "a bigint, b bigint")


def promising(pairs: DataFrame, classes: DataFrame, percent: int, partners: int = PARTNERS) -> DataFrame:
    """The pairs that may be similar enough by their prefixes: these have all rare n-grams of both up to one place of the
    order, so that the n-grams in common are at most those seen there and the rest of the smaller set."""
    def values(batch):
        prefixes = [np.frombuffer(p, np.uint64) for p in batch.column("prefix").to_pylist()]
        return zip(batch.column("n_shingles").to_pylist(), prefixes)

    def similar(x, y):
        (n, p), (m, q) = x, y
        last = min(p[-1], q[-1])
        p, q = p[:np.searchsorted(p, last)], q[:np.searchsorted(q, last)]
        most = int(np.isin(p, q).sum()) + min(n - len(p), m - len(q))
        return (100 + percent) * most >= percent * (n + m)

    data = classes.select(F.col("rep").alias("doc"), "n_shingles", "prefix")
    return _compared(_dealt(pairs, data, ["n_shingles", "prefix"], partners), values, similar)


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int, partners: int = PARTNERS) -> DataFrame:
    """The pairs whose whole sets are similar enough. docs(doc, text) has one text per class."""
    def values(batch):
        return shingles(batch.column("text").to_pylist(), width)

    def similar(x, y):
        both = len(np.intersect1d(x, y, assume_unique=True))
        return 100 * both >= percent * (len(x) + len(y) - both)

    return _compared(_dealt(pairs, docs, ["text"], partners), values, similar)


def class_rows(sets: DataFrame) -> DataFrame:
    """One row per set: rep (its smallest id), n_shingles, prefix, ranges. Only sets that repeat are shuffled."""
    usable = sets.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    again = usable.groupBy("set_key").agg(F.count("*").alias("n")).where("n > 1")
    marked = _among(usable, again, "set_key", "again")
    columns = [F.col("doc_id").alias("rep"), "n_shingles", "prefix", "ranges"]
    repeated = marked.where("again").select("set_key", F.struct("doc_id", "n_shingles", "prefix", "ranges").alias("row")).groupBy("set_key").agg(
        F.min("row").alias("row"))
    return marked.where("NOT again").select(*columns).unionByName(
        stored(repeated.select("row.*").select(*columns), "ngram-classes"))


def similar_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id per row of docs(doc_id, text)."""
    levels = rarity(docs, width)
    sets = stored(document_sets(docs, levels, width, percent), "ngram-sets")
    usable = sets.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    heads = usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"))
    classes = class_rows(sets)
    rows = stored(postings(classes, percent), "ngram-postings")
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc"), text_bytes("text").alias("text"))
    tried = stored(star_pairs(rows, percent, block), "ngram-stars")
    links = stored(verified(promising(tried, classes, percent), texts, width, percent).distinct(), "ngram-links")
    parts_of = components(links, "ngram-parts")
    known = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = remaining_pairs(rows, parts_of, percent, block).join(known, ["a", "b"], "left_anti")
    more = stored(verified(promising(rest, classes, percent), texts, width, percent), "ngram-links")
    found = components(links.unionByName(more), "ngram-parts")
    state = heads.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_key", F.coalesce("component", "rep").alias("component_id"))
    return sets.select("doc_id", "n_shingles", "set_key").join(state, "set_key", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def links(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All links (a, b) with a < b between classes, by their smallest ids, each verified once; then the sets of all
    rows and (set_key, rep, members) of the classes. A group of near copies turns into all its pairs here."""
    levels = rarity(docs, width)
    sets = stored(document_sets(docs, levels, width, percent), "ngram-sets")
    usable = sets.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
    # each id counts once in a class
    heads = stored(usable.select("set_key", "doc_id").distinct().groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.count("*").alias("members")), "ngram-heads")
    classes = class_rows(sets)
    rows = stored(postings(classes, percent), "ngram-postings")
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc"), text_bytes("text").alias("text"))
    apart = docs.sparkSession.createDataFrame([], "node bigint, component bigint")  # every class is its own part, so no pair is skipped
    tried = promising(remaining_pairs(rows, apart, percent, block), classes, percent)
    found = stored(verified(tried, texts, width, percent).distinct(), "ngram-links")
    return found, sets, heads


def linked_documents(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, n_links, component_id per row of docs(doc_id, text): n_links is the number of other
    documents it links with, equal sets among them. If an id repeats with unlike texts, each row has its own number."""
    found, sets, heads = links(docs, width, percent, block)
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    others = both.join(heads.select(F.col("rep").alias("b"), "members"), "b").groupBy("a").agg(F.sum("members").alias("others"))
    state = heads.join(others.withColumnRenamed("a", "rep"), "rep", "left").join(
        components(found, "ngram-parts").withColumnRenamed("node", "rep"), "rep", "left").select(
        "set_key", (F.coalesce("others", F.lit(0)) + F.col("members") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    known = F.col("doc_id").isNotNull()
    return sets.select("doc_id", "n_shingles", "set_key").join(state, "set_key", "left").select(
        "doc_id", "n_shingles", F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("bigint").alias("n_links"),
        F.when(known, F.coalesce("component_id", "doc_id")).alias("component_id"))
