"""Keyed state: however many facts wait, a turn reads and writes them as one value."""

from __future__ import annotations

import datetime
import pickle

from pyspark.sql import Row
from pyspark.sql.types import StructType

from palaver.streaming import keyed

T0 = datetime.datetime(2024, 1, 1)


class Value:
    def __init__(self):
        self.value, self.calls = None, 0

    def get(self):
        self.calls += 1
        return self.value

    def update(self, value):
        self.calls += 1
        self.value = value


class Handle:
    def __init__(self):
        self.values, self.timers = {}, set()

    def getValueState(self, name, schema):  # noqa: N802
        return self.values.setdefault(name, Value())

    def registerTimer(self, at):  # noqa: N802
        self.timers.add(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)


def test_waiting_facts_are_one_value(spark):
    fact = StructType.fromDDL("seq long, kind string, at timestamp")
    timers = keyed.Timers(StructType(), fact, StructType.fromDDL("id long, step long, seq long, due timestamp, status string"), ("view",), 30, True)
    handle = Handle()
    timers.init(handle)
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    rows = [Row(seq=k, kind="view", at=at(10 * k)) for k in range(500)]
    waiting = list(timers.turn((1,), iter(reversed(rows)), 0))
    assert [r["status"] for r in waiting] == ["cancelled"] * 499 + ["open"]
    assert sum(v.calls for v in handle.values.values()) <= 4 and len(handle.timers) == 1
    now = round(at(10_000).timestamp() * 1000)
    late = list(timers.turn((1,), iter([Row(seq=900, kind="click", at=at(9_000))]), now))
    assert [(r["seq"], r["status"]) for r in late][-2:] == [(498, "cancelled"), (499, "fired")]
    assert pickle.loads(handle.values["kept"].value[0]) == ([], []) and not handle.timers
