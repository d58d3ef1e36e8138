"""What stateful processors ask of the store for a key and a batch."""

import pandas as pd

from dialspan.streaming.processors import StateProcessor


class Store:
    def __init__(self):
        self.values, self.timers, self.calls = [], [], []

    def getListState(self, name, schema):  # noqa: N802
        assert schema == "t array<long>, state array<string>"
        return self

    def exists(self):
        return bool(self.values)

    def get(self):
        return iter(self.values)

    def put(self, values):
        self.values = values
        self.calls.append(len(values))

    def clear(self):
        self.values = []

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)

    def registerTimer(self, at):  # noqa: N802
        assert at not in self.timers
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.watermark


def test_waiting_rows_are_one_value():
    store, p = Store(), StateProcessor("user", 10_000)
    p.init(store)
    rows = lambda *seconds: iter([pd.DataFrame([("u", pd.Timestamp(s, unit="s"), f"s{s}") for s in seconds], columns=["user", "ts", "state"])])
    store.watermark = 0
    assert list(p.handleInputRows(("u",), rows(3, 1, 2), store)) == [] and store.calls == [1] and store.timers == [1999]
    assert list(p.handleInputRows(("u",), rows(2), store)) == [] and store.calls == [1]  # nothing new waits
    store.watermark = 2500
    out = pd.concat(p.handleExpiredTimer(("u",), store, None))
    assert out["state"].tolist() == ["s1"] and out["end"].tolist() == [pd.Timestamp(2, unit="s")] and store.timers == [2999]
    store.watermark = 60_000
    out = pd.concat(p.handleExpiredTimer(("u",), store, None))
    assert out["ended_by"].tolist() == ["next", "expiry"] and not store.values and not store.timers
