"""Best-fit packing of token sequences by patterns of few documents.

Documents are cut into pieces of at most `room` tokens. The histogram of piece lengths (at
most `room` numbers, whatever the corpus) is packed on the driver: patterns of few lengths, on
a coarse grid, that fill a sequence are fitted to the histogram by non-negative least squares, the
repeat counts are rounded, and what is left over goes best-fit into the gaps, longest first. The plan
is a list of runs: "pieces r0..r1 of length L go to sequences s0.. at offset o". Pieces then look
up their place by their rank among pieces of their length, so no piece passes the driver.

Cases: a null or empty text is a piece of one token (the end token); repeated rows are packed
each; an empty table gives no rows; a text of any length is tokenized whole.
"""

from __future__ import annotations

import functools
import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tsubo.llm.common import PerWorker, give_back, stored, text_bytes

ROOM = 4096
END = 1
GRID = 32
MOST_PARTS = 4
SALTS = 64
CACHED_WORDS = 400_000
PIECE = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


class _Recent:
    """A dictionary of the entries used last: two generations of at most `room` each."""

    def __init__(self, room: int):
        self.room, self.now, self.old = room, {}, {}

    def turn(self) -> None:
        if len(self.now) > self.room:
            self.old, self.now = self.now, {}

    def missing(self, keys: set) -> list:
        """Keys that are in neither generation; those of the old one come along."""
        out = []
        for key in keys.difference(self.now):
            value = self.old.get(key)
            if value is None:
                out.append(key)
            else:
                self.now[key] = value
        return out


class WordIds:
    """Token ids (as little-endian bytes) of a text, by a cache of white-space separated chunks.

    The tokenizer never joins text across ASCII white space, lower-cases, and splits a full stop or comma
    that ends a chunk after a letter. So a text's ids are those of its chunks one after the other, and
    chunks differ from known words by capitals and such an ending only. A word has the ids of the chunk that is
    written like it, so one cache holds both. A tokenizer of another kind needs `split=False`.
    """

    def __init__(self, path: str, room: int = CACHED_WORDS, split: bool = True):
        from tokenizers import Tokenizer

        self.tokenizer, self.split = Tokenizer.from_file(path), split
        self.chunks = _Recent(room)
        self.ends = dict(zip(b".,", self._encode([".", ","])))

    def _encode(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _learn(self, chunks: list[bytes]) -> None:
        parts, words = [], set()
        for chunk in chunks:
            word, end = chunk, b""
            if b"<" not in chunk:  # special tokens are case sensitive
                word = chunk.lower()
                if len(word) > 1 and word[-1] in self.ends and 97 <= word[-2] <= 122:
                    end, word = self.ends[word[-1]], word[:-1]
            words.add(word)
            if word != chunk:
                parts.append((chunk, word, end))
        new = self.chunks.missing(words)
        if new:
            self.chunks.now.update(zip(new, self._encode([w.decode() for w in new])))
        for chunk, word, end in parts:
            self.chunks.now[chunk] = self.chunks.now[word] + end

    def __call__(self, text: bytes) -> bytes:
        if not self.split:
            return self._encode([text.decode()])[0]
        chunks = text.split()
        self.chunks.turn()
        new = self.chunks.missing(set(chunks))
        if new:
            self._learn(new)
        return b"".join(map(self.chunks.now.__getitem__, chunks))


def pieces(docs: DataFrame, path: str, room: int = ROOM, end: int = END, with_ids: bool = False, split: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids (binary, 4 bytes each)."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64()), *([("ids", pa.binary())] if with_ids else [])])

    # one per worker process, so that the tasks of a worker share what it knows
    word_ids = docs.sparkSession.sparkContext.broadcast(PerWorker(functools.partial(WordIds, path, split=split)))

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        ids_of, last = word_ids.value(), np.array([end], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = ids_of(text) + last
                for k, at in enumerate(range(0, len(ids), 4 * room)):
                    part = ids[at:at + 4 * room]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), part))
            columns = list(zip(*rows))[:len(schema)] if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
        give_back()

    return docs.select(F.col("doc_id").cast("bigint"), text_bytes("text")).mapInArrow(
        run, PIECE + (", ids binary" if with_ids else ""))


# ------------------------------------------------------------------ the plan, from a histogram
def patterns(units: int, most: int = MOST_PARTS) -> np.ndarray:
    """All ways to write `units` as a sum of up to `most` parts, as columns of counts per part size."""
    found: list[tuple[int, ...]] = []

    def extend(parts: tuple[int, ...], left: int, largest: int) -> None:
        if left <= largest and left:
            found.append((*parts, left))
        if len(parts) + 1 < most:
            for size in range(min(largest, left - 1), 0, -1):
                if size * (most - len(parts)) < left:
                    break
                extend((*parts, size), left - size, size)

    extend((), units, units)
    table = np.zeros((units + 1, len(found)))
    for j, parts in enumerate(found):
        for part in parts:
            table[part, j] += 1
    return table


def nonnegative_fit(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Lawson and Hanson's active set method: x >= 0 with the smallest |a x - b|."""
    x, active = np.zeros(a.shape[1]), []
    scale = max(float(np.abs(b).max()), 1.0)
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= 1e-4 * scale:
            break
        active.append(best)
        while True:
            part = a[:, active]
            solved = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(active)), part.T @ b)
            if (solved > 0).all():
                break
            old = x[active]
            bad = solved <= 0
            step = np.min(old[bad] / (old[bad] - solved[bad] + 1e-300))
            moved = old + step * (solved - old)
            x[:] = 0
            keep = [(j, v) for j, v in zip(active, moved) if v > 1e-12 * scale]
            active = [j for j, _ in keep]
            for j, v in keep:
                x[j] = v
            if not active:
                break
        if not active:
            break
        x[:] = 0
        x[active] = solved
    return x


def plan(counts: np.ndarray, room: int = ROOM, grid: int = GRID, most: int = MOST_PARTS) -> np.ndarray:
    """Rows (length, first rank, pieces, first sequence, offset) that place counts[length] pieces.

    The result has as many rows as there are runs, bounded by lengths and patterns.
    """
    left = counts.astype(np.int64).copy()
    used_up = np.zeros(room + 1, np.int64)
    runs: list[tuple[int, int, int, int, int]] = []
    sequences = 0
    spaces: dict[int, list[tuple[int, int]]] = {}   # free tokens -> (first sequence, sequences)
    keys: list[int] = []                            # the spaces in use, ascending

    def put(space: int, first: int, n: int) -> None:
        if space > 0 and n > 0:
            if space not in spaces:
                keys.insert(bisect_left(keys, space), space)
            spaces.setdefault(space, []).append((first, n))

    def place(length: int, n: int, first: int, offset: int) -> None:
        runs.append((length, int(used_up[length]), n, first, offset))
        used_up[length] += n
        left[length] -= n

    # full pieces need no company
    if left[room]:
        n = int(left[room])
        place(room, n, sequences, 0)
        sequences += n

    units = max(room // grid, 1)
    size_of = -(-np.arange(room + 1) // grid)  # rounded up, so that a pattern always fits
    coarse = np.bincount(size_of, weights=left, minlength=units + 1)[:units + 1]
    if coarse.sum() > 0:
        table = patterns(units, most)
        repeats = np.rint(nonnegative_fit(table, coarse)).astype(np.int64)
        for j in np.argsort(-repeats, kind="stable")[:int((repeats > 0).sum())]:
            parts = [int(p) for p in np.repeat(np.arange(units + 1), table[:, j].astype(int))][::-1]
            stock = np.bincount(size_of, weights=left, minlength=units + 1)
            n = min([int(repeats[j]), *[int(stock[p]) // parts.count(p) for p in set(parts)]])
            if n <= 0:
                continue
            segments = [(sequences, n, 0)]
            sequences += n
            for i, part in enumerate(parts):
                filled = []
                length = min(part * grid, room)
                for first, size, offset in segments:
                    if i == len(parts) - 1:
                        length = room - offset  # the last part may use what rounding up has left free
                    while size:
                        while not left[length]:
                            length -= 1
                        m = min(size, int(left[length]))
                        place(length, m, first, offset)
                        filled.append((first, m, offset + length))
                        first, size = first + m, size - m
                segments = filled
            for first, size, offset in segments:
                put(room - offset, first, size)

    # the rest: best fit, longest first, many equal sequences at a time
    for length in range(room - 1, 0, -1):
        while left[length]:
            k = bisect_left(keys, length)
            if k < len(keys):
                space = keys[k]
                first, size = spaces[space].pop()
                if not spaces[space]:
                    del spaces[space], keys[k]
                m = min(size, int(left[length]))
                place(length, m, first, room - space)
                put(space - length, first, m)
                put(space, first + m, size - m)
            else:
                each = room // length
                n = int(left[length]) // each
                if n:
                    for i in range(each):
                        place(length, n, sequences, i * length)
                    put(room - each * length, sequences, n)
                    sequences += n
                if left[length]:
                    put(room, sequences, 1)
                    sequences += 1
    return np.array(runs, dtype=np.int64).reshape(-1, 5)


# ------------------------------------------------------------------ placing the pieces
def placed(parts: DataFrame, room: int = ROOM, grid: int = GRID, most: int = MOST_PARTS, salts: int = SALTS) -> DataFrame:
    """The pieces with sequence_id and offset. parts is a stored table: it is read twice.

    A length that very many pieces share is ranked in `salts` independent groups.
    """
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(salts)).cast("int"))
    counts = np.zeros((room + 1, salts), np.int64)
    # at most room x salts rows
    for row in salted.groupBy("length", "_salt").agg(F.count("*").alias("n")).toLocalIterator():
        counts[row["length"], row["_salt"]] = row["n"]
    runs = plan(counts.sum(axis=1), room, grid, most)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    before = np.cumsum(counts, axis=1) - counts
    wide = np.int64(1) << np.int64(44)
    starts = runs[:, 0] * wide + runs[:, 1]
    ranked = salted.withColumn("_rank", F.row_number().over(
        W.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")))
    names = parts.columns

    def look_up(batches):
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = before[length, batch.column("_salt").to_numpy()] + batch.column("_rank").to_numpy() - 1
            run = runs[np.searchsorted(starts, length * wide + rank, side="right") - 1]
            columns = [batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(run[:, 3] + rank - run[:, 1]), pa.array(run[:, 4])],
                names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    return ranked.mapInArrow(look_up, f"{kinds}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, path: str, room: int = ROOM, with_ids: bool = False) -> DataFrame:
    """Every document's pieces with their place in a sequence."""
    return placed(stored(pieces(docs, path, room, with_ids=with_ids), "pack-pieces"), room)


def sequences(packed: DataFrame, columns: str = "ids") -> DataFrame:
    """One row per sequence: the ids of its pieces in order. A sequence holds at most `room` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", columns, "doc_id", "piece")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"),
        F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p[columns])).alias("ids"))
