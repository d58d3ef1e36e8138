"""Stateful processors of the streaming jobs: what waits for the watermark is list state, an open episode value state.

Rows of a key may come in any order inside the watermark's delay, so they wait until the
watermark has passed them and are then taken by time. An event-time timer wakes a key for
the next thing that waits; a key with nothing left has no state.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EPISODE_SQL = "start_us long, end_us long, last_us long, duration_ms double, duration_basis string, start_basis string, status string, signals long"
EPISODE = [c.split()[0] for c in EPISODE_SQL.split(", ")]
#: Phases in the order in which those of one time count.
LAST = {"end": 1}


class Waiting(StatefulProcessor):
    """Collects rows of a key until the watermark has passed them; ``ready`` says what then comes out and which time is waited for next."""

    waiting_sql: str
    columns: list[str]

    def __init__(self, key: str):
        self.key = key

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", re.sub(r"(\w+) (\w+)", r"\1 array<\2>", self.waiting_sql))  # what waits at once is one value

    def row(self, row: tuple) -> tuple:
        raise NotImplementedError

    def ready(self, rows: list[tuple], until_us: int) -> tuple[list[tuple], list[tuple], int | None]:
        """(what comes out, what still waits, the time in microseconds that is to be reached next) of the sorted ``rows``."""
        raise NotImplementedError

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield from self.advanced(key, [self.row(r) for batch in rows for r in batch.itertuples(index=False, name=None)], timerValues)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield from self.advanced(key, [], timerValues)

    def advanced(self, key: tuple, new: list[tuple], timers) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        before = [row for part in self.waiting.get() for row in zip(*part, strict=True)] if self.waiting.exists() else []
        rows = sorted({*before, *new}, key=self.place)
        out, rest, wake = self.ready(rows, timers.getCurrentWatermarkInMs() * 1000)
        if rest and rest != before:
            self.waiting.put([tuple(list(column) for column in zip(*rest, strict=True))])
        elif before and not rest:
            self.waiting.clear()
        at = None if wake is None else -(-wake // 1000) - 1  # a timer runs once the watermark is beyond it
        set_before = list(self.handle.listTimers())
        for timer in set_before:
            if timer != at:
                self.handle.deleteTimer(timer)
        if at is not None and at not in set_before:
            self.handle.registerTimer(at)
        if out:
            yield pd.DataFrame([(key[0], *o) for o in out], columns=[self.key, *self.columns])

    def place(self, row: tuple) -> tuple:
        return row

    def close(self) -> None:
        pass


class StateProcessor(Waiting):
    """States until the next one or ``ttl_ms``."""

    waiting_sql, columns = "t long, state string", ["start", "end", "state", "ended_by"]

    def __init__(self, key: str, ttl_ms: int):
        super().__init__(key)
        self.ttl_us = ttl_ms * 1000

    def row(self, row: tuple) -> tuple:
        return int(row[1].value // 1000), row[2]

    def place(self, row: tuple) -> tuple:
        return row[0], row[1] or ""

    def ready(self, rows: list[tuple], until_us: int) -> tuple[list[tuple], list[tuple], int | None]:
        out, at = [], 0
        while at < len(rows):
            t, state = rows[at]
            expiry = t + self.ttl_us
            end = min(expiry, rows[at + 1][0]) if at + 1 < len(rows) else expiry
            if end > until_us:
                return out, rows[at:], end
            out.append((pd.Timestamp(t, unit="us"), pd.Timestamp(end, unit="us"), state, "expiry" if end == expiry else "next"))
            at += 1
        return out, [], None


class EpisodeProcessor(Waiting):
    """Episodes of start, missing, ongoing and end signals."""

    waiting_sql, columns = "t long, phase string, d double", EPISODE

    def __init__(self, key: str, ttl_ms: int):
        super().__init__(key)
        self.ttl_us = ttl_ms * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.open = handle.getValueState("open", "start long, first string, length double, basis string, last long, signals long")

    def row(self, row: tuple) -> tuple:
        return int(row[1].value // 1000), row[2], None if row[3] is None or pd.isna(row[3]) else float(row[3])

    def place(self, row: tuple) -> tuple:
        return row[0], LAST.get(row[1], 0), row[2] is not None, row[2] or 0.0, row[1]

    def ready(self, rows: list[tuple], until_us: int) -> tuple[list[tuple], list[tuple], int | None]:
        held = self.open.get() if self.open.exists() else None
        episode, out, at = held, [], 0
        while at < len(rows) and rows[at][0] <= until_us:
            t, phase, d = rows[at]
            if episode is not None and (phase == "start" or t - episode[4] > self.ttl_us):
                out.append(left_open(episode))
                episode = None
            episode = extended(episode, t, phase, d)
            if phase == "end":
                out.append(closed(episode, d))
                episode = None
            at += 1
        if episode is not None and episode[4] + self.ttl_us < until_us:
            out.append(left_open(episode))
            episode = None
        if episode is not None:
            self.open.update(episode)
        elif held is not None:
            self.open.clear()
        rest = rows[at:]
        return out, rest, rest[0][0] if rest else episode[4] + self.ttl_us + 1 if episode is not None else None


def extended(episode: tuple | None, t: int, phase: str, d: float | None) -> tuple:
    """The episode (start, first basis, length, basis of it, last signal, signals) after one more signal."""
    back = t - math.floor((d or 0.0) * 1000 + 0.5)
    if episode is None:
        first = {"start": "observed", "missing": "threshold", "ongoing": "reported_elapsed"}.get(phase, "unknown" if d is None else "reported_duration")
        told = d if phase in ("missing", "ongoing") else None
        return t if phase == "start" else back, first, told, "minimum" if phase == "missing" or told is not None else None, t, 1
    start, first, length, basis, _, signals = episode
    if phase == "missing":
        start = min(start, back)
        length = (t - start) / 1000
    elif phase == "ongoing" and d is not None:
        length, basis = d, "minimum"
    return start, first, length, basis, t, signals + 1


def closed(episode: tuple, d: float | None) -> tuple:
    start, first, _, _, t, signals = episode
    span = max((t - start) / 1000, 0.0)
    duration, why = (d, "reported") if d is not None else (span, "minimum") if first == "threshold" else (span, "timestamps") if first == "observed" else (None, "unknown")
    return start, t, t, duration, why, first, "closed", signals


def left_open(episode: tuple) -> tuple:
    start, first, length, basis, t, signals = episode
    return start, None, t, length, basis or "unknown", first, "open", signals
