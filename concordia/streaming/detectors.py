"""Keyed detectors on streams of polls: a text that has settled, and readings that have all come.

State is one small row for each key, in the state store, so a lost executor costs a replay of its last batch. With a clock, a key's state
is dropped KEEP_MS after its last change, and its timers once it has fired; without one (timers=False, or no ttl) the store keeps a
marker for every key that it has seen. Rows are in order of seq within a batch; between batches they count as they come. A null
snapshot is a blank one, a null witness or key's rows are taken as they are: a null witness counts for none, null keys are one key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

QUIET_MS, TOTAL_MS, KEEP_MS = 30_000, 120_000, 3_600_000


class _Settled(StatefulProcessor):
    """Fires once for a key: when a non-blank snapshot came need times in a row, or at a time limit with what there is."""

    def __init__(self, need: int, timers: bool, keep: int = KEEP_MS):
        self.need, self.timers, self.keep = need, timers, keep

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("settled", "last string, same int, done boolean, began long", self.keep if self.timers else None)

    def _close(self, began: int) -> None:
        """From now on the key needs a mark alone, and no timer."""
        self.state.update(("", 0, True, began))
        if self.timers:
            for limit in list(self.handle.listTimers()):
                self.handle.deleteTimer(limit)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        polls = pd.concat(list(rows)).sort_values("seq")
        known = self.state.exists()
        last, same, done, began = self.state.get() if known else ("", 0, False, 0)
        if done:
            return
        if not known and self.timers:
            began = timerValues.getCurrentProcessingTimeInMs()
            for limit in (QUIET_MS, TOTAL_MS):
                self.handle.registerTimer(began + limit)
        for seq, snap in zip(polls["seq"], polls["snap"]):
            snap = snap if isinstance(snap, str) else ""
            same = same + 1 if snap and snap == last else 0
            last = snap or last
            if same and same >= self.need - 1:
                self._close(began)
                yield pd.DataFrame({"key": [key[0]], "fired_at": [int(seq)], "text": [last], "how": ["settled"]})
                return
        self.state.update((last, same, False, began))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.state.exists():
            return
        last, _, done, began = self.state.get()
        over = expiredTimerInfo.getExpiryTimeInMs() >= began + TOTAL_MS
        if not done and (over or not last):
            self._close(began)
            yield pd.DataFrame({"key": [key[0]], "fired_at": pd.array([None], "Int64"), "text": [last], "how": ["total" if over else "quiet"]})

    def close(self) -> None:
        pass


class _Gathered(StatefulProcessor):
    """Fires once for a key, when each of the readings has been reported; of a witness's reports the first counts."""

    def __init__(self, witnesses: int, ttl: int | None):
        self.witnesses, self.ttl = witnesses, ttl

    def init(self, handle) -> None:
        self.first = handle.getMapState("first", "witness string", "seq long", self.ttl)
        self.ready = handle.getValueState("ready", "ready boolean", self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.ready.exists():
            return
        seen = {k[0]: v[0] for k, v in self.first.iterator()}
        new: dict[str, int] = {}
        for b in rows:
            for witness, seq in zip(b["witness"], b["seq"]):
                if isinstance(witness, str) and int(seq) < min(seen.get(witness, int(seq) + 1), new.get(witness, int(seq) + 1)):
                    new[witness] = int(seq)
        seen |= new
        if len(seen) >= self.witnesses:
            self.first.clear()
            self.ready.update((True,))
            yield pd.DataFrame({"key": [key[0]], "ready_at": [max(seen.values())]})
            return
        for witness, seq in new.items():
            self.first.updateValue((witness,), (seq,))

    def close(self) -> None:
        pass


def settled(polls: DataFrame, need: int = 2, timers: bool = True, keep: int = KEEP_MS) -> DataFrame:
    """(key, fired_at, text, how) from a stream of key, seq, snap. Needs the RocksDB state store."""
    kind = dict(polls.dtypes)["key"]
    return polls.groupBy("key").transformWithStateInPandas(_Settled(need, timers, keep), f"key {kind}, fired_at long, text string, how string", "Append", "ProcessingTime" if timers else "None")


def gathered(reports: DataFrame, witnesses: int, ttl: int | None = None) -> DataFrame:
    """(key, ready_at) from a stream of key, witness, seq. ttl: milliseconds after which a key is forgotten. Needs the RocksDB state store."""
    kind = dict(reports.dtypes)["key"]
    return reports.groupBy("key").transformWithStateInPandas(_Gathered(witnesses, ttl), f"key {kind}, ready_at long", "Append", "None" if ttl is None else "ProcessingTime")
