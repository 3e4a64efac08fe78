"""State that is folded in event-time order, whatever batch a row came with."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: A key silent for so long (event time) is over and its state goes.
IDLE_MS = 24 * 3600 * 1000


class OrderedProcessor(StatefulProcessor):
    """Rows wait in a list until the watermark has passed their event time; no earlier row can come then, so they are folded in order.

    One timer a key is pending: for the earliest row that waits, else for the end of the key.  A key holds at most what the
    watermark's delay lets arrive, never its history.  ``row_schema`` ends with ``event_ms long``; rows at the same time are
    ordered by ``order``.
    """

    def __init__(self, row_schema: str, order: list[str], out: list[str], idle_ms: int = IDLE_MS):
        self.row_schema, self.order, self.out, self.idle_ms = row_schema, order, out, idle_ms
        self.columns = [c.split()[0] for c in row_schema.split(", ")]
        self.places = [self.columns.index(c) for c in ("event_ms", *order)]

    # what a processor adds: its own states, how a row changes them, what time alone brings, and how they go
    def open(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def fold(self, rows: list[dict]) -> Iterator[dict]:
        raise NotImplementedError

    def passed(self, mark: int) -> Iterator[dict]:
        return iter(())

    def forget(self) -> None:
        raise NotImplementedError

    # ---
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row_schema)
        self.clock = handle.getValueState("clock", "due long, seen long")
        self.open(handle)

    def handleInputRows(self, key, rows, timerValues):
        # every call of the state costs a round trip to the JVM: one read and as few writes as the rows need
        due, seen = self.clock.get() or (None, 0)
        new = [tuple(None if x is pd.NaT or (isinstance(x, float) and x != x) else x for x in r)
               for pdf in rows for r in zip(*[pdf[c].tolist() for c in self.columns])]
        if new:
            self.waiting.appendList(new)
            times = [int(r[-1]) for r in new]
            first = min(times)
            if due is None or first < due:
                due = first
                self.handle.registerTimer(due)
            self.clock.update((due, max(seen, *times)))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        mark = timerValues.getCurrentWatermarkInMs()
        due, seen = self.clock.get() or (None, 0)
        held = list(self.waiting.get()) if due is not None else []  # without a due row none waits
        ready = sorted((r for r in held if r[-1] <= mark), key=lambda r: [(r[p] is not None, r[p]) for p in self.places])
        over = len(ready) == len(held) and seen + self.idle_ms <= mark
        out = list(self.fold([dict(zip(self.columns, r)) for r in ready])) if ready else []
        out += self.passed(mark)
        later = [tuple(r) for r in held if r[-1] > mark]
        if later:
            if ready:
                self.waiting.put(later)
            due = min(int(r[-1]) for r in later)
            self.handle.registerTimer(due)
        else:
            if held:
                self.waiting.clear()
            due = None
            if not over:
                self.handle.registerTimer(seen + self.idle_ms)
        if over:
            self.clock.clear()
            self.forget()
        else:
            self.clock.update((due, seen))
        if out:
            yield pd.DataFrame([[x.get(c) for c in self.out] for x in out], columns=self.out, dtype=object)

    def close(self) -> None:
        pass
