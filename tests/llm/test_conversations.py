"""Conversation repair against enumerated edits and a plain pass over the rows."""

import hashlib
import random
import re
import zlib

import pytest

from tsubo.llm import conversations as C

SPACES = "\t\n\x0b\x0c\r "


def plain(steps, sources=(0,), targets=(0, 3)):
    """Least (cost, audit) by one pass over the rows, with inserts between."""
    rows, inserts = C._edges(C._STEP.findall(steps))

    def better(best, to, label):
        if to not in best or label < best[to]:
            best[to] = label

    def with_inserts(best):
        for _ in range(3):
            for letter, cost, q, to in inserts:
                if q in best:
                    better(best, to, (best[q][0] + cost, best[q][1] + letter))
        return best

    best = with_inserts({q: (0, "") for q in sources})
    for edges in rows:
        after = {}
        for letter, cost, q, to in edges:
            if q in best:
                better(after, to, (best[q][0] + cost, best[q][1] + letter))
        best = with_inserts(after)
    return min((best[q] for q in targets if q in best), default=None)


def enumerated(steps, most_inserts):
    rows, inserts = C._edges(C._STEP.findall(steps))
    found = []

    def go(i, place, cost, audit, left):
        if i == len(rows) and place in C.ENDS:
            found.append((cost, audit))
        if left:
            for letter, price, q, to in inserts:
                if q == place:
                    go(i, to, cost + price, audit + letter, left - 1)
        if i < len(rows):
            for letter, price, q, to in rows[i]:
                if q == place:
                    go(i + 1, to, cost + price, audit + letter, left)

    go(0, C.START, 0, "", most_inserts)
    return min(found)


def test_least_cost_and_audit_of_enumerated_edits():
    rng = random.Random(5)
    for _ in range(150):
        steps = re.sub("1+", "1", "".join(rng.choice("suaxUAS1") for _ in range(rng.randrange(5))))
        assert C.cheapest(steps) == enumerated(steps, 3), steps


def test_every_start_and_end_and_pieces_put_together():
    rng = random.Random(6)
    for _ in range(60):
        steps = "".join(rng.choice("suaxUAS") for _ in range(rng.randrange(40)))
        cut = rng.randrange(len(steps) + 1)
        table = C.table_of(steps)
        assert table == [[plain(steps, (q,), (to,)) for to in C.PLACES] for q in C.PLACES]
        assert C.followed(C.table_of(steps[:cut]), C.table_of(steps[cut:])) == table


def by_hand(rows):
    """The result of one conversation's rows (turn, role, text), already in order."""
    none = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "",
            "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    if not rows:
        return none
    turns = [t for t, _, _ in rows if t is not None]
    out = dict(none, gaps=max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0)
    seen, steps, bodies = set(), [], []
    for _, role, text in rows:
        bare = text.rstrip(SPACES)
        fault = "blank" if not bare.strip(SPACES) else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            out[fault] += 1
        if fault in ("blank", "duplicate"):
            steps.append("1")
            continue
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        steps.append(initial.upper() if fault else initial)
        bodies.append((role, text))
    initials = [role[:1] for _, role, _ in rows]
    out["illegal"] = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    # runs of one row each, so that inserts may also come between rows that must go
    spread = "".join(steps)
    found = plain_with_single_runs(spread)
    out["cost"], out["audit"] = found
    repaired, place, kept = [], 0, iter(bodies)
    at = iter(spread)
    for letter in found[1]:
        step = None if letter == "I" else next(at)
        body = next(kept) if step and step != "1" else None
        if letter == "K":
            place = C.KEEP[step.lower()][place]
            repaired.append(":".join(body))
        elif letter in "RI":
            place = C.TURN[place]
            repaired.append(f"{C.NAMES[place]}:{body[1] if body else ''}")
    out["repaired_sha256"] = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
    return out


def plain_with_single_runs(steps):
    edges = C._STEP
    C._STEP = re.compile("[a-zA-Z0-9]")
    try:
        return plain(steps)
    finally:
        C._STEP = edges


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[2])))


SCHEMA = "conv_id bigint, turn bigint, role string, text string, present string, seq int, steps string, `range` int, times string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "no", 1, "z", 2, "t") for r in rows], SCHEMA)


def random_rows(rng):
    texts = ["Yes.", "No", "Why? ", "", " \n", None, "Well!", "Über uns…", "A long answer. " * 30, "a\tb."]
    rows = []
    for conv in [None, *range(25)]:
        for turn in range(rng.randrange(12)):
            turn = rng.choice([turn, turn, turn, None, 3])
            rows += [(conv, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice(texts))] * rng.choice([1, 1, 1, 2])
    rows += [(100, t, "user" if t % 2 else "assistant", f"line {t % 900}" + "." * (t % 3)) for t in range(1800)]  # many pieces
    rows += [(101, 5, "user", "Same.")] * 700 + [(102, None, None, None)]
    return rows


@pytest.mark.parametrize("limits", [(512, 1 << 18), (3, 1 << 18), (512, 20)])
def test_repair_against_a_plain_version(spark, limits):
    rows = random_rows(random.Random(7))
    result = {r["conv_id"]: r.asDict() for r in C.repaired(frame(spark, rows), None, *limits).collect()}
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert set(result) == set(groups)
    for conv, own in groups.items():
        want = by_hand(in_order(own))
        assert {k: result[conv][k] for k in want} == want, conv


def test_damage_and_conversations_without_rows(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", "One. Two!") for c in range(400) for t in range(1 + c % 4)] + [(None, None, None, None)]
    result = {r["conv_id"]: r.asDict() for r in C.repaired(C.damaged(frame(spark, rows)), "present").collect()}
    groups = {}
    for conv, turn, role, text in rows:
        own = groups.setdefault(conv, [])
        role, text = role or " ", text or " "
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 1:
            text = ""
        if fault == 2:
            text = text.replace(".", "").replace("!", "")
        if fault == 4:
            role = "user"
        own += [(turn, role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
    assert any(not own for own in groups.values())
    assert set(result) == set(groups)
    for conv, own in groups.items():
        want = by_hand(in_order(own))
        assert {k: result[conv][k] for k in want} == want, conv


def test_empty_table(spark):
    assert C.repaired(C.damaged(frame(spark, [])), "present").collect() == []
