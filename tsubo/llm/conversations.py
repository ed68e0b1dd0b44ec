"""Repair of the turn structure of conversations by the cheapest edits.

A good conversation is empty or an optional system row, then user and assistant rows in turns, ending with the
assistant. Nodes of the edit lattice are (rows used up, place in that pattern); edges keep, rerole or
delete the next row or insert an empty one. A bidirectional Dijkstra search grows one heap from the
start and one from the end; it goes on until every crossing of the least cost is found, and takes the one whose
audit (the edits' initials in order) is least. Among paths of one cost with the same ends no audit is the
beginning of another, as further inserts would cost more; so least halves make a least whole.

Rows are sorted by range partitions, so one conversation may be spread over many tasks. A task repairs
the conversations that lie inside it. The first and last one of a range and those beyond `PIECE_ROWS` rows or
`PIECE_BYTES` bytes become pieces: a piece is searched from every place to every place of the
pattern, these 4 x 4 results are combined in order, and each piece then gets its part of the edits. Only the hash of a
repaired conversation is one after the other, piece by piece; a task holds one byte a row of it.

Cases: a null role or text is one space; a null turn sorts first; a null conv_id is a conversation of its own. Rows of
one turn are taken by role and the text's SHA-256. Repeated rows are counted, so copies travel as one row. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsubo.llm.common import stored

PIECE_ROWS = 512
PIECE_BYTES = 1 << 18
CACHED = 100_000
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1  # costs; keeping is free, a row kept without its end costs CUT_OFF

# places in the pattern: nothing yet, after system, after user, after assistant
START, SYSTEM, USER, ASSISTANT = range(4)
PLACES, ENDS = range(4), (START, ASSISTANT)
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # the place after the row that must follow
KEEP = {"s": {START: SYSTEM}, "u": {q: USER for q in (START, SYSTEM, ASSISTANT)}, "a": {USER: ASSISTANT}, "x": {}}
NAMES = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}

_STEP = re.compile(r"\d+|[a-zA-Z]")
_END = re.compile(r"[.!?][\x20\x09-\x0D]*\Z")
_BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")


# ------------------------------------------------------------------ the search
def _edges(steps: list[str]) -> tuple[list, list]:
    """Edges (letters, cost, place before, place after) of each step, and those of inserts."""
    rows = []
    for step in steps:
        if step.isdigit():  # a run of rows that must go
            rows.append([("D" * int(step), DELETE * int(step), q, q) for q in PLACES])
        else:
            more = CUT_OFF if step.isupper() else 0
            rows.append([("D", DELETE, q, q) for q in PLACES]
                        + [("K", more, q, to) for q, to in KEEP[step.lower()].items()]
                        + [("R", REROLE + more, q, to) for q, to in TURN.items()])
    return rows, [("I", INSERT, q, to) for q, to in TURN.items()]


def cheapest(steps: str, sources: tuple = (START,), targets: tuple = ENDS) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest edits of `steps` from a source to a target place, or None.

    `steps` has a letter per row: its role's initial (x for others), in capitals if the text is cut off;
    a number stands for so many rows that must go.
    """
    parts = _STEP.findall(steps)
    rows, inserts = _edges(parts)
    n = len(parts)
    out = {(i, q): [] for i in range(n + 1) for q in PLACES}
    into = {node: [] for node in out}
    for i in range(n + 1):
        for letters, cost, q, to in inserts:
            out[i, q].append((letters, cost, (i, to)))
            into[i, to].append((letters, cost, (i, q)))
        for letters, cost, q, to in rows[i] if i < n else ():
            out[i, q].append((letters, cost, (i + 1, to)))
            into[i + 1, to].append((letters, cost, (i, q)))

    # [label of each seen node, heap]; at one cost the nodes nearer to the side's origin come first, as
    # free edges lead away from it, so a node's least audit is known when it is taken
    forward = ({(0, q): (0, "") for q in sources}, [(0, 0, (0, q)) for q in sources])
    reverse = ({(n, q): (0, "") for q in targets}, [(0, -n, (n, q)) for q in targets])
    best = min((0 for node in forward[0] if node in reverse[0]), default=None)
    settled: tuple[set, set] = (set(), set())
    while forward[1] or reverse[1]:
        tops = [side[1][0][0] if side[1] else None for side in (forward, reverse)]
        # a used-up heap has seen all it can reach; the other side cannot add crossings then
        if None in tops or best is not None and sum(tops) > best:
            break
        k = 0 if tops[0] <= tops[1] else 1
        (labels, heap), others = (forward, reverse)[k], (reverse, forward)[k][0]
        cost, _, node = heapq.heappop(heap)
        if node in settled[k] or labels[node][0] != cost:
            continue
        settled[k].add(node)
        audit = labels[node][1]
        for letters, price, to in (out, into)[k][node]:
            label = (cost + price, audit + letters if k == 0 else letters + audit)
            if to not in labels or label < labels[to]:
                if to not in labels or label[0] < labels[to][0]:
                    heapq.heappush(heap, (label[0], -to[0] if k else to[0], to))
                labels[to] = label
                if to in others and (best is None or label[0] + others[to][0] < best):
                    best = label[0] + others[to][0]
    if best is None:
        return None
    return best, min(label[1] + reverse[0][node][1] for node, label in forward[0].items()
                     if node in reverse[0] and label[0] + reverse[0][node][0] == best)


@functools.lru_cache(maxsize=CACHED)
def _short(steps: str) -> tuple[int, str]:
    return cheapest(steps)


def repair(steps: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation; short ones are remembered, as few shapes are common."""
    return _short(steps) if len(steps) <= 32 else cheapest(steps)


def table_of(steps: str) -> list[list[tuple[int, str] | None]]:
    """The cheapest edits of a piece from every place to every place."""
    return [[cheapest(steps, (q,), (to,)) for to in PLACES] for q in PLACES]


def followed(first: list, second: list) -> list[list[tuple[int, str] | None]]:
    """The table of two pieces, one after the other."""
    return [[min(((a[0] + b[0], a[1] + b[1]) for a, b in zip(row, column) if a and b), default=None)
             for column in zip(*second)] for row in first]


def lines(audit: str, steps: str, bodies: list[tuple[str, str]], place: int = START) -> tuple[list[str], int]:
    """The repaired rows (role:text) of a piece, and the place in the pattern after it."""
    found, parts, rows = [], iter(_STEP.findall(steps)), iter(bodies)
    at = 0
    while at < len(audit):
        letter = audit[at]
        at += 1
        if letter == "I":
            place = TURN[place]
            found.append(f"{NAMES[place]}:")
            continue
        step = next(parts)
        if step.isdigit():
            at += int(step) - 1
            continue
        role, text = next(rows)
        if letter == "K":
            place = KEEP[step.lower()][place]
            found.append(f"{role}:{text}")
        elif letter == "R":
            place = TURN[place]
            found.append(f"{NAMES[place]}:{text}")
    return found, place


def place_after(audit: str, steps: str, place: int) -> int:
    """The place in the pattern after the edits of a piece."""
    blanks = [("", "")] * sum(not s.isdigit() for s in _STEP.findall(steps))
    return lines(audit, steps, blanks, place)[1]


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------ pieces of conversations
_COUNTS = ("n_rows", "turns", "blank", "duplicate", "truncated", "illegal")
_PIECE = pa.schema(
    [("conv_id", pa.int64()), ("range", pa.int32()), ("seq", pa.int64()), ("closed", pa.bool_())]
    + [(name, pa.int64()) for name in (*_COUNTS, "low", "high")]
    + [("first", pa.string()), ("last", pa.string()), ("steps", pa.string()),
       ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())),
       ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_RESULT = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
           "cost bigint, audit string, repaired_sha256 string")


class _Piece:
    """Counts and steps of a run of rows of one conversation, in order."""

    def __init__(self):
        self.counts = dict.fromkeys(_COUNTS, 0)
        self.low = self.high = None
        self.first = self.last = ""
        self.steps: list[str] = []
        self.forced = 0
        self.bodies: list[tuple[str, str]] = []
        self.rows = self.bytes = 0

    def add(self, turn, role: str, text: str, times: int, new: bool) -> None:
        c = self.counts
        self.rows += 1
        c["n_rows"] += times
        if turn is not None:
            if turn != self.high:
                c["turns"] += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        c["illegal"] += times - 1 + (self.rows > 1 and self.last + initial not in LEGAL)
        self.first, self.last = self.first or initial, initial
        if _BLANK.match(text):
            c["blank"] += times
            self.forced += times
            return
        if new:
            self._close_run()
            cut_off = not _END.search(text)
            c["truncated"] += cut_off
            self.steps.append(initial.upper() if cut_off else initial)
            self.bodies.append((role, text))
            self.bytes += len(text) + len(role)
        c["duplicate"] += times - new
        self.forced += times - new

    def _close_run(self) -> None:
        if self.forced:
            self.steps.append(str(self.forced))
            self.forced = 0

    def ended(self) -> str:
        self._close_run()
        return "".join(self.steps)


def _sewn(total: dict, piece: dict) -> dict:
    """Counts of a conversation with those of its next piece."""
    if not piece["n_rows"]:
        return total
    if not total["n_rows"]:
        return dict(piece)
    out = {name: total[name] + piece[name] for name in _COUNTS}
    out["illegal"] += total["last"] + piece["first"] not in LEGAL
    out["turns"] -= piece["low"] is not None and piece["low"] == total["high"]
    out["low"] = piece["low"] if total["low"] is None else total["low"]
    out["high"] = total["high"] if piece["high"] is None else piece["high"]
    out["last"] = piece["last"]
    return out


def _gaps(low, high, turns) -> int:
    return 0 if low is None else high - low + 1 - turns


def damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows with reproducible faults; `present` is false for a row that was dropped."""
    def value(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    fault = F.crc32(F.concat_ws(":", value("conv_id"), value("turn")).cast("binary")) % 20
    text, role = value("text"), value("role")
    return rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (fault != 0).alias("present"),
        F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))).alias("_again")).drop("_again")


def _sorted_rows(rows: DataFrame, flag: str | None) -> DataFrame:
    """Different rows of a conversation in order, with their number and whether role and text are new there.

    The join that finds new ones is by conversation, role, text and turn, so no text or conversation is one task.
    """
    def value(name):
        return F.when(F.col("present"), F.coalesce(F.col(name).cast("string"), F.lit(" ")))

    present = F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(True)
    rows = rows.select("conv_id", "turn", "role", "text", present.alias("present")).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "present", F.when(F.col("present"), F.col("turn").cast("bigint")).alias("turn"),
        value("role").alias("role"), value("text").alias("text"))
    different = rows.groupBy("conv_id", "present", "turn", "role", F.sha2("text", 256).alias("digest")).agg(
        F.first("text").alias("text"), F.count("*").alias("times"))
    first = different.where("present").groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("at"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"),
                         F.col("at.turn").alias("t"), F.lit(True).alias("new"))
    same = (F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
            & F.col("turn").eqNullSafe(F.col("t")))
    order = ["conv_id", "present", "turn", "role", "digest"]
    return different.join(first, same, "left").select(*order, "text", "times", F.col("new").isNotNull().alias("new")).repartitionByRange(
        *order).sortWithinPartitions(*order).select("conv_id", "present", "turn", "role", "text", "times", "new")


def _pieces(batches, most_rows: int, most_bytes: int):
    """Pieces of the sorted rows of one range; a conversation that lies inside it is repaired at once."""
    from pyspark import TaskContext

    own = TaskContext.get().partitionId()
    state = {"seq": 0, "conversations": 0, "parts": 0}

    def row(conv_id, piece: _Piece, last: bool) -> tuple:
        steps = piece.ended()
        closed = not last and state["conversations"] > 1 and state["parts"] == 0
        if closed:
            cost, audit = repair(steps)
            result = (None, None, None, cost, audit, _sha("\n".join(lines(audit, steps, piece.bodies)[0])))
        else:
            result = (steps, [r for r, _ in piece.bodies], [t for _, t in piece.bodies], None, None, None)
        state["seq"] += 1
        return (conv_id, own, state["seq"], closed, *piece.counts.values(), piece.low, piece.high, piece.first, piece.last, *result)

    def batch(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found) if found else [[] for _ in _PIECE]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PIECE)], schema=_PIECE)

    current, piece, found = None, None, []
    for rows in batches:
        for conv_id, present, turn, role, text, times, new in zip(*(c.to_pylist() for c in rows.columns)):
            if piece is None or conv_id != current:
                if piece is not None:
                    found.append(row(current, piece, False))
                current, piece = conv_id, _Piece()
                state["conversations"] += 1
                state["parts"] = 0
            elif piece.rows >= most_rows or piece.bytes >= most_bytes:
                # the rest follows as a further piece
                found.append(row(current, piece, True))
                state["parts"] += 1
                piece = _Piece()
            if present:
                piece.add(turn, role, text, times, new)
        yield batch(found)
        found = []
    if piece is not None:
        yield batch([row(current, piece, True)])


_OPEN = [f for f in _PIECE if f.name in ("conv_id", "range", "seq", *_COUNTS, "low", "high", "first", "last", "steps")]
_SHARE = pa.schema([("range", pa.int32()), ("seq", pa.int64()), ("share", pa.string()), ("place", pa.int32()), ("gaps", pa.int64())]
                   + [(name, pa.int64()) for name in ("all_blank", "all_duplicate", "all_truncated", "all_illegal", "all_cost")]
                   + [("all_audit", pa.string())])


def _shares(pieces: list[dict]) -> list[tuple]:
    """What each piece of one conversation gets of its edits; the last row carries the conversation's results."""
    stack: list[tuple[int, list]] = []  # tables of 1, 2, 4, ... pieces, so that strings are joined few times
    total = dict.fromkeys(_COUNTS, 0) | {"low": None, "high": None, "first": "", "last": ""}
    for piece in pieces:
        total = _sewn(total, piece)
        stack.append((1, table_of(piece["steps"])))
        while len(stack) > 1 and stack[-2][0] == stack[-1][0]:
            (size, first), (_, second) = stack[-2:]
            stack[-2:] = [(2 * size, followed(first, second))]
    table = functools.reduce(followed, [t for _, t in stack])
    cost, audit = min(table[START][end] for end in ENDS if table[START][end])
    out, at, place = [], 0, START
    for k, piece in enumerate(pieces):
        start, left = at, piece["n_rows"]
        while left or (k == len(pieces) - 1 and at < len(audit)):
            left -= audit[at] != "I"
            at += 1
        share = audit[start:at]
        out.append((piece["range"], piece["seq"], share, place, *[None] * 7))
        place = place_after(share, piece["steps"], place)
    out[-1] = (*out[-1][:4], _gaps(total["low"], total["high"], total["turns"]), total["blank"], total["duplicate"],
               total["truncated"], total["illegal"], cost, audit)
    return out


def _by_conversation(batches, finish):
    """Calls finish(rows) for each conversation of batches sorted by it."""
    current, rows = None, []
    for batch in batches:
        for r in batch.to_pylist():
            if rows and r["conv_id"] != current:
                yield from finish(rows)
                rows = []
            current = r["conv_id"]
            rows.append(r)
    if rows:
        yield from finish(rows)


def _all_shares(batches):
    found = list(_by_conversation(batches, _shares))
    columns = zip(*found) if found else [[] for _ in _SHARE]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SHARE)], schema=_SHARE)


def _hashed(batches):
    """The result row of each conversation from its pieces in order; the text goes through a running hash."""
    names = [c.split()[0] for c in _RESULT.split(", ")]
    hasher, empty, found = hashlib.sha256(), True, []
    for batch in batches:
        for r in batch.to_pylist():
            repaired, _ = lines(r["share"], r["steps"], list(zip(r["roles"], r["texts"])), r["place"])
            if repaired:
                hasher.update(("" if empty else "\n").encode() + "\n".join(repaired).encode())
                empty = False
            if r["all_audit"] is not None:
                found.append((r["conv_id"], r["gaps"], *(r[f"all_{n}"] for n in names[2:-1]), hasher.hexdigest()))
                hasher, empty = hashlib.sha256(), True
    schema = pa.schema([(n, pa.string() if n in ("audit", "repaired_sha256") else pa.int64()) for n in names])
    columns = zip(*found) if found else [[] for _ in schema]
    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "bigint", pa.int32(): "int", pa.bool_(): "boolean", pa.string(): "string"}
    return ", ".join(f"`{f.name}` {kinds.get(f.type, 'array<string>')}" for f in schema)


def repaired(rows: DataFrame, present: str | None = None, piece_rows: int = PIECE_ROWS, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """conv_id, gaps, counts of faults, cost, audit and repaired_sha256 of every conversation in rows(conv_id, turn, role, text).

    `present` may name a column; rows in which it is not true only name their conversation.
    """
    def cut(batches):
        return _pieces(batches, piece_rows, piece_bytes)

    pieces = stored(_sorted_rows(rows, present).mapInArrow(cut, _ddl(_PIECE)), "conversation-pieces")
    whole = pieces.where("closed").select(
        "conv_id", F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    split = pieces.where("NOT closed")
    order = ["conv_id", "range", "seq"]
    shares = split.select(*[f.name for f in _OPEN]).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(
        _all_shares, _ddl(_SHARE))
    joined = split.select(*order, "steps", "roles", "texts").join(shares, ["range", "seq"])
    return whole.unionByName(joined.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_hashed, _RESULT))
