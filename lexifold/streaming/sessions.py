"""Session ownership and the sticky agent as state of the stream (ST1 to ST3, J12, Q22).

A session's events are held until the watermark has passed them, so that they are decided in the order
(ts, seq) however they arrive.  An event belongs to the agent last routed to before it, else to the
first one routed to afterwards; one that no agent follows is decided when its session closes, which a
timer of event time does ``gap`` after the session's last event.  What arrives behind events that have
been decided is late: it is decided against the agent then in force and gives a row of its own; rows
that were given are never taken back, and a session that was closed begins anew.

The state of a session is the agent in force, the time of its last event, the events that the
watermark has not passed and those that still wait for an agent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OWNED = "session string, seq long, kind string, agent string, owner string, switched boolean, late boolean"
_EVENT = "at long, seq long, kind string, agent string"


class SessionOwner(StatefulProcessor):
    """Decides the owner of each event of a session, and for each routing whether it changes the agent."""

    def __init__(self, gap_seconds: float):
        self.gap = int(gap_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "agent string, last long")
        self.ahead = handle.getListState("ahead", _EVENT)
        self.waiting = handle.getListState("waiting", _EVENT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            if key[0] is not None:
                columns = (batch[c].tolist() for c in ("at", "seq", "kind", "agent"))
                events = [(at, seq, kind, agent if isinstance(agent, str) else None) for at, seq, kind, agent in zip(*columns, strict=True)]
                self.ahead.appendList(events)
                self.handle.registerTimer(min(e[0] for e in events) // 1000 + 1)
        yield _rows([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = sorted((tuple(e) for e in self.ahead.get()), key=lambda e: e[:2])
        ready = [e for e in held if e[0] <= passed]
        rest = held[len(ready) :]
        out = self._decide(key, ready) if ready else []
        if ready:
            self.ahead.clear()
        if ready and rest:
            self.ahead.put(rest)
        if rest:
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        elif self.held.exists() and self.held.get()[1] + self.gap < passed:
            out += [_row(key, tuple(e), None) for e in self.waiting.get()]  # no agent followed
            self.waiting.clear()
            self.held.clear()
        yield _rows(out)

    def _decide(self, key, events: list) -> list:
        """Rows of ``events`` in their order; what is older than an event decided before is late."""
        agent, last = self.held.get() if self.held.exists() else (None, None)
        waiting = [tuple(e) for e in self.waiting.get()]
        had, known, out = len(waiting), last, []
        for at, seq, kind, to in events:
            late = known is not None and at < known
            if last is not None and at - last > self.gap:
                out += [_row(key, e, None) for e in waiting]
                agent, waiting = None, []
            if kind == "routed" and to is not None:
                out += [_row(key, e, to) for e in waiting]
                waiting = []
                out.append((key[0], seq, kind, to, agent or to, agent != to, late))
                agent = agent if late and agent else to  # the newer routing stays in force
            elif agent is not None:
                out.append((key[0], seq, kind, to, agent, None, late))
            else:
                waiting.append((at, seq, kind, to))
            last = at if last is None else max(at, last)
        self.held.update((agent, last))
        if had:
            self.waiting.clear()
        if waiting:
            self.waiting.appendList(waiting)
        self.handle.registerTimer((last + self.gap) // 1000 + 1)
        return out

    def close(self) -> None:
        pass


def _row(key, e: tuple, owner: str | None) -> tuple:
    return key[0], e[1], e[2], e[3], owner, None, False


def _rows(rows: list) -> pd.DataFrame:
    names = [c.split()[0] for c in OWNED.split(", ")]
    out = pd.DataFrame(rows, columns=names, dtype=object)
    return out.astype({"seq": "int64", "late": "bool"})


def owned(events: DataFrame, delay: str = "1 hour", gap_seconds: float = 86_400) -> DataFrame:
    """A stream (session, seq, kind, agent, owner, switched, late) of a stream of events (session, seq, ts, kind, agent).

    ``delay`` is how late an event may be and still be put in order.  Rows of the null session give no
    rows; they only move the watermark, as a heartbeat does.  One session is one key: its micro-batch
    is one task's, so ``maxFilesPerTrigger`` bounds what a very long session holds at once.
    """
    marked = events.withWatermark("ts", delay)
    # An expression carries no watermark, so Spark does not drop what is late before it gets here.
    rows = marked.select("session", F.expr("unix_micros(ts)").alias("at"), "seq", "kind", "agent")
    return rows.groupBy("session").transformWithStateInPandas(SessionOwner(gap_seconds), outputStructType=OWNED, outputMode="Append", timeMode="EventTime")
