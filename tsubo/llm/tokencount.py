"""Token counts of a piece vocabulary by byte-pair merging with a heap and linked symbols.

A text begins as one symbol per character; characters outside the vocabulary are one symbol per UTF-8
byte. The adjacent pair of the lowest rank (best score, leftmost among equals) merges first,
until no adjacent pair is a piece. The count is the symbols at the start less the merges; no ids are made.

Merges never cross a place whose two characters stand together in no piece. Where the vocabulary has no piece
with a space mark after another character, chunks begin at space marks, at line feeds and at punctuation
that no piece has after a letter; they are merged one by one and the counts of recent chunks are kept in a
bounded cache. A vocabulary without that property is merged as one chunk.

Cases: null is the empty text with no tokens; texts are read whole, however long; repeated rows are counted
each; an empty table gives no rows; other columns are kept out of the result.
"""

from __future__ import annotations

import functools
import heapq
import re
import string

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsubo.llm.common import text_bytes

LIMIT = 4096
SPACE = "▁"
CACHED_CHUNKS = 400_000
LONGEST_CACHED = 64  # characters of a chunk worth keeping
LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"


class _Recent(dict):
    """Counts of chunks, made when first asked for; those before the last clearing are kept once more."""

    def __init__(self, count, room: int):
        super().__init__()
        self.count, self.room, self.older = count, room, {}

    def turn(self) -> None:
        if len(self) > self.room:
            self.older = dict(self)
            self.clear()

    def __missing__(self, chunk: str) -> int:
        found = self.older.get(chunk)
        if found is None:
            found = self.count(chunk)
        if len(chunk) <= LONGEST_CACHED:
            self[chunk] = found
        return found


class MergeCounts:
    """Counts the tokens of texts as the vocabulary of a sentencepiece model merges them."""

    def __init__(self, path: str, room: int = CACHED_CHUNKS):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.normalize = model.normalize
        scores = {model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
                  if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        place = {score: rank for rank, score in enumerate(sorted(set(scores.values()), reverse=True))}
        self.ranks = {piece: place[score] for piece, score in scores.items() if len(piece) > 1}
        self.characters = {piece for piece in scores if len(piece) == 1}
        self.known = _Recent(self.chunk, room)
        self.chunks = self._chunks()

    def _chunks(self):
        """The function that cuts a text where no merge can cross."""
        pairs = {piece[i:i + 2] for piece in self.ranks for i in range(len(piece) - 1)}
        if any(b == SPACE != a for a, b in pairs):
            return lambda text: [text]
        joined = set().union(*pairs)
        alone = [c for c in "\n\r\t" if c not in joined]
        # marks that stand after a letter in no piece: a chunk ends between the two
        after_letters = {b for a, b in pairs if re.match(f"[{LETTERS}]", a)}
        marks = "".join(c for c in string.punctuation if c not in after_letters)
        apart, mark = SPACE + re.escape("".join(alone)), re.escape(marks)
        plain, no_letter = f"[^{apart}{mark}]", f"[^{LETTERS}{apart}{mark}]"
        chunk = f"{plain}+" if not marks else f"(?:[{mark}]+|{plain}*{no_letter}[{mark}]+)*{plain}*"
        parts = [f"{SPACE}*(?=[^{apart}]){chunk}", f"{SPACE}+", f"[{re.escape(''.join(alone))}]+" if alone else ""]
        return re.compile("|".join(filter(None, parts))).findall

    def merges(self, symbols: list[str]) -> int:
        """How often adjacent symbols merge; `symbols` is used up."""
        ranks, n = self.ranks, len(symbols)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            rank = ranks.get(symbols[i] + symbols[i + 1])
            if rank is not None:
                heap.append((rank, i, i + 1, len(symbols[i]) + len(symbols[i + 1])))
        heapq.heapify(heap)
        done = 0
        while heap:
            _, i, j, size = heapq.heappop(heap)
            # a pair is stale when one side has merged since; an absorbed symbol is empty
            if not symbols[i] or not symbols[j] or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            done += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < n:
                    rank = ranks.get(symbols[a] + symbols[b])
                    if rank is not None:
                        heapq.heappush(heap, (rank, a, b, len(symbols[a]) + len(symbols[b])))
        return done

    def chunk(self, chunk: str) -> int:
        first = sum(1 if c in self.characters else len(c.encode()) for c in chunk)
        return first - self.merges(list(chunk))

    def __call__(self, text: str) -> int:
        self.known.turn()
        return sum(map(self.known.__getitem__, self.chunks(self.normalize(text))))


@functools.lru_cache(maxsize=1)
def _counter(path: str) -> MergeCounts:
    """One per worker process, so that the tasks of a worker share what it knows."""
    return MergeCounts(path)


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches):
        count = _counter(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([count(t.decode("utf-8", "replace")) for t in texts], pa.int64())], schema=schema)

    counted = docs.select(F.col("doc_id").cast("bigint"), text_bytes("text")).mapInArrow(
        run, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
