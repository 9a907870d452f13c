"""Detectors on a clock of their own, and as streams with time limits."""

import time

import pandas as pd
import pytest

from concordia.streaming import detectors as D


class Value:
    def __init__(self):
        self.row = None

    def exists(self):
        return self.row is not None

    def get(self):
        return self.row

    def update(self, row):
        self.row = row


class Map(dict):
    def iterator(self):
        return iter(list(self.items()))

    def updateValue(self, k, v):
        self[k] = v


class Handle:
    def __init__(self):
        self.timers, self.value, self.map = set(), Value(), Map()

    def getValueState(self, name, schema, ttl=None):
        return self.value

    def getMapState(self, name, key, value, ttl=None):
        return self.map

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def listTimers(self):
        return iter(self.timers)


class Clock:
    def __init__(self, now):
        self.now = now

    def getCurrentProcessingTimeInMs(self):
        return self.now

    getExpiryTimeInMs = getCurrentProcessingTimeInMs


def run(need, *events):
    """Events (ms, snapshots) or (ms, None) for the timer of that time; what fired, and the handle."""
    handle, p = Handle(), D._Settled(need, True)
    p.init(handle)
    out, seq = [], 0
    for at, snaps in events:
        if snaps is None:
            if at in handle.timers:
                handle.deleteTimer(at)
                out += list(p.handleExpiredTimer((1,), Clock(at), Clock(at)))
            continue
        rows = pd.DataFrame({"seq": range(seq, seq + len(snaps)), "snap": snaps})
        seq += len(snaps)
        out += list(p.handleInputRows((1,), iter([rows.sample(frac=1, random_state=1)]), Clock(at)))
    return [(r["how"].item(), r["text"].item()) for r in out], handle


@pytest.mark.parametrize(
    "need, events, want",
    [
        (2, [(0, ["a", "b", "b", "b"]), (9, ["c", "c"])], [("settled", "b")]),
        (3, [(0, ["a", "a"]), (5, [None, "a"]), (9, ["a", "a"])], [("settled", "a")]),
        (2, [(0, [""]), (30_000, None), (31_000, ["x", "x"])], [("quiet", "")]),
        (2, [(0, ["x"]), (30_000, None), (50_000, ["y"]), (120_000, None), (121_000, ["y"])], [("total", "y")]),
        (2, [(0, ["x", "x"]), (30_000, None), (120_000, None)], [("settled", "x")]),
    ],
)
def test_fires_once_and_leaves_a_mark_alone(need, events, want):
    got, handle = run(need, *events)
    assert got == want and handle.timers == set() and handle.value.row[:3] == ("", 0, True)


def test_waits_and_keeps_its_timers():
    got, handle = run(2, (0, ["x"]), (30_000, None))
    assert got == [] and handle.timers == {120_000} and handle.value.row == ("x", 0, False, 0)


def test_gathered_clears_what_it_gathered():
    handle, p = Handle(), D._Gathered(2, None)
    p.init(handle)
    feed = lambda *rows: [r["ready_at"].item() for r in p.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["witness", "seq"])]), None)]
    assert feed(("a", 5), ("a", 3), (None, 1)) == [] and dict(handle.map) == {("a",): (3,)}
    assert feed(("b", 4)) == [4] and not handle.map
    assert feed(("c", 9), ("b", 1)) == []


def test_stream_with_time_limits(spark, tmp_path, monkeypatch):
    """One key that settles, one that never shows a text, one whose text keeps changing."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [(1, 1, "a"), (1, 2, "a"), (2, 1, ""), (3, 1, "x"), (3, 2, "y")]
    spark.createDataFrame(rows, "key long, seq long, snap string").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("key long, seq long, snap string").parquet(str(tmp_path / "in"))
    out = D.settled(src, keep=600_000)
    q = out.writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        while time.time() < end and spark.table("limits").count() < 2:
            time.sleep(1)
        got = sorted((r["key"], r["how"], r["text"]) for r in spark.table("limits").collect())
        assert got[0] == (1, "settled", "a") and got[1] == (2, "quiet", "")
    finally:
        q.stop()
