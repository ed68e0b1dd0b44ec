"""Stateful processors: what one key keeps between micro-batches, in the RocksDB state store."""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor

PROGRESS = (
    "key bigint, at bigint, id bigint, failed boolean, n bigint, failures bigint, streak bigint, "
    "recent_rate double, part string, turn bigint"
)
_Shown = Row(*[c.split()[0] for c in PROGRESS.split(", ")])


class Progress(StatefulProcessor):
    """Counters, failure streak and recent failure rate of a key's requests (at, id, failed), in the order of events.

    Kept are the counters up to the last released request, the outcomes of the requests before it, and
    the requests that wait for the watermark. A timer releases them in order as part `done`, once and for all.
    Until then they are shown as part `waiting`, anew in every turn. A request older than a released one
    comes out as part `late`. So the state of a key holds what arrived within the watermark's delay.
    """

    def __init__(self, last: int):
        self.last = last

    def init(self, handle) -> None:
        self.handle = handle
        self.done = handle.getValueState("done", "n bigint, failures bigint, success bigint, tail string, at bigint, id bigint")
        self.waiting = handle.getListState("waiting", "at bigint, id bigint, failed boolean")
        self.turns = handle.getValueState("turns", "turn bigint")

    def _next(self, state: tuple, request: tuple) -> tuple:
        n, failures, success, tail, _, _ = state
        at, ident, failed = request
        n += 1
        failures += failed is True
        success = n if failed is False else success
        tail = (tail + {True: "1", False: "0", None: "-"}[failed])[-self.last:]
        return n, failures, success, tail, at, ident

    def _row(self, key, state: tuple, failed, part: str, turn: int) -> Row:
        n, failures, success, tail, at, ident = state
        known = tail.count("0") + tail.count("1")
        rate = tail.count("1") / known if known else None
        return _Shown(key[0], at, ident, failed, n, failures, n - success, rate, part, turn)

    def _shown(self, key, state: tuple, requests: list[tuple], part: str, turn: int) -> Iterator[Row]:
        for request in requests:
            state = self._next(state, request)
            yield self._row(key, state, request[2], part, turn)

    def _state(self) -> tuple:
        return tuple(self.done.get()) if self.done.exists() else (0, 0, 0, "", None, None)

    def _turn(self) -> int:
        turn = (self.turns.get()[0] if self.turns.exists() else 0) + 1
        self.turns.update((turn,))
        return turn

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state, turn, fresh = self._state(), self._turn(), []
        for row in rows:
            request = (row["at"], row["id"], row["failed"])
            if state[4] is not None and request[:2] < state[4:]:
                yield _Shown(key[0], *request, None, None, None, None, "late", turn)
            else:
                fresh.append(request)
        if fresh:
            self.waiting.appendList(fresh)
            self.handle.registerTimer(max(r[0] for r in fresh) // 1000 + 1)
        yield from self._shown(key, state, self._sorted(), "waiting", turn)

    def _sorted(self) -> list[tuple]:
        return sorted((tuple(r) for r in self.waiting.get()), key=lambda r: r[:2]) if self.waiting.exists() else []

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        requests = self._sorted()
        n = bisect_left(requests, passed, key=lambda r: r[0])
        if not n:
            return
        state, turn = self._state(), self._turn()
        for request in requests[:n]:
            state = self._next(state, request)
            yield self._row(key, state, request[2], "done", turn)
        self.done.update(state)
        if requests[n:]:
            self.waiting.put(requests[n:])
        else:
            self.waiting.clear()
        yield from self._shown(key, state, requests[n:], "waiting", turn)

    def close(self) -> None:
        pass


class Days(StatefulProcessor):
    """The last snapshot of each day of a listing; rows come in any order.

    For each day that a micro-batch changes, the day and the one after it come out with the snapshot before
    them. Days are kept by year, so a row reads and writes one year's days, however long the history is.
    """

    def __init__(self, order: list[str], fields: list[str]):
        self.order, self.fields = order, fields

    def init(self, handle) -> None:
        self.shown = Row("property_id", "snapshot_at", *self.fields, "old_at", *[f"old_{f}" for f in self.fields])
        self.years = handle.getMapState("years", "year int", "days binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = sorted(r[0] for r in self.years.keys())
        loaded: dict[int, dict] = {}  # year -> {day: (order, fields)}
        sorted_days: dict[int, list] = {}

        def days(year: int) -> dict:
            if year not in loaded:
                loaded[year] = pickle.loads(bytes(self.years.getValue((year,))[0])) if year in known else {}
            return loaded[year]

        changed = set()
        for row in rows:
            day = row["snapshot_at"]
            own = days(day.year)
            order = tuple((row[c] is not None, row[c]) for c in self.order)
            values = tuple(row[c] for c in self.fields)
            if day not in own or order > own[day][0]:
                if day not in own or values != own[day][1]:
                    changed.add(day)
                own[day] = (order, values)
        for year in {day.year for day in changed}:
            self.years.updateValue((year,), (pickle.dumps(loaded[year]),))
        every = sorted({*known, *loaded})

        def listed(year: int) -> list:
            if year not in sorted_days:
                sorted_days[year] = sorted(days(year))
            return sorted_days[year]

        def neighbour(day, step: int):
            own = listed(day.year)
            at = bisect_left(own, day) - 1 if step < 0 else bisect_right(own, day)
            if 0 <= at < len(own):
                return own[at]
            others = [y for y in every if (y - day.year) * step > 0 and listed(y)]
            if not others:
                return None
            return listed(others[-1])[-1] if step < 0 else listed(others[0])[0]

        for day in sorted(changed | {neighbour(d, 1) for d in changed} - {None}):
            before = neighbour(day, -1)
            old = days(before.year)[before][1] if before else (None,) * len(self.fields)
            yield self.shown(key[0], day, *days(day.year)[day][1], before, *old)

    def close(self) -> None:
        pass
