"""Best-fit packing of documents into token sequences.

Hierarchical residual packing: each partition packs its pieces best-fit, largest first, and gives out bins that are nearly
full; bins with room go up a tree as items of their own, and groups of them are packed again in best-fit rounds, until one group is
left.

Best fit opens a bin only for an item that no open bin takes. So any two bins of a packing exceed one sequence together, and at
most one is no more than half full. Bins of different packings that are both over half full can't share a sequence either: a round
over FAN packings can only move their at most FAN small bins. A round therefore needs, besides these, FAN bins of each fill and no
more, and what it is offered is bounded by the number of fills whatever the input: OFFERS bins of each fill, enough for all rounds
above (FAN for each), without loss against offering all of them. The rest stay sequences as they are.

Odd rows: a null or empty text is the end id alone; rows that repeat a key and rows with a null key are packed as they are; very
long texts are cut into pieces, the first being the short one; among bins of one room the last that got it takes an item; an
empty table gives an empty one. Only key and text are read, whatever other columns there are.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import END_BYTE, encoder
from .workspace import Workspace, arrow_batches, freed

LENGTH, FULL, FAN = 2048, 0.99, 8
#: Bins of each fill that a packing offers: FAN for each round of a tree over FAN ** 8 partitions.
OFFERS = 8 * FAN
#: Pieces that a partition packs at once; the small bin that is left goes on into the next packing.
BUFFER = 50_000


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, and how full each bin is. Items go largest first into the tightest bin that has room.

    Bins are kept by free room; the bits of one integer tell which rooms occur, so the tightest is its lowest bit from the
    item's size on.
    """
    bins, offsets, filled = [0] * len(sizes), [0] * len(sizes), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[i]
        high = mask >> size
        if high:
            room = size + (high & -high).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                mask &= ~(1 << room)
        else:
            b, room = len(filled), capacity
            filled.append(0)
        bins[i], offsets[i] = b, filled[b]
        filled[b] += size
        if room > size:
            by_room[room - size].append(b)
            mask |= 1 << (room - size)
    return bins, offsets, filled


class _Pieces:
    """Columns of the pieces that wait to be packed."""

    def __init__(self):
        self.keys, self.rest = [], [array("q") for _ in range(4)]

    def add(self, key, *rest: int) -> None:
        self.keys.append(key)
        for column, x in zip(self.rest, rest):
            column.append(x)

    def __len__(self) -> int:
        return len(self.keys)

    def take(self, at: np.ndarray) -> "_Pieces":
        out = _Pieces()
        out.keys = [self.keys[i] for i in at]
        out.rest = [array("q", np.frombuffer(c, np.int64)[at].tobytes()) for c in self.rest]
        return out


def _local(docs: DataFrame, tokenizer: str, end: int, capacity: int, key: str, text: str, offers: int, buffer: int) -> DataFrame:
    """Pieces with their bin, its fill, their offset and whether the bin is offered to the rounds above."""
    names = [key, "piece", "start", "length", "ids_crc32", "bin", "fill", "offset", "offer"]

    def work(batches):
        from pyspark import TaskContext

        enc, tail = encoder(tokenizer), np.array([end], "<u4").tobytes()
        first, wait, offered = TaskContext.get().partitionId() << 36, _Pieces(), np.zeros(capacity + 1, np.int64)

        def packed(last: bool):
            nonlocal first, wait
            columns = [np.frombuffer(c, np.int64) for c in wait.rest]
            bins, offsets, filled = (np.array(x, np.int64) for x in best_fit(columns[2].tolist(), capacity))
            out = np.ones(len(bins), bool) if last else 2 * filled[bins] > capacity
            offer = np.zeros(len(filled), bool)
            for b in np.flatnonzero((filled < FULL * capacity) & ((2 * filled > capacity) | last)):
                offer[b] = offered[filled[b]] < offers
                offered[filled[b]] += 1
            made = [pa.array([k for k, o in zip(wait.keys, out) if o], pa.int64())]
            made += [pa.array(x[out]) for x in (columns[0].astype(np.int32), *columns[1:], first + bins, filled[bins].astype(np.int32), offsets, offer[bins])]
            del columns
            wait = wait.take(np.flatnonzero(~out))
            first += len(filled)
            return pa.RecordBatch.from_arrays(made, names)

        for batch in batches:
            for k, t in zip(batch.column(key), batch.column(text)):
                k, ids = k.as_py(), enc.ids(t.as_py()) + tail
                n = len(ids) // 4
                at = 0
                for p in range((n + capacity - 1) // capacity):
                    size = (n - 1) % capacity + 1 if p == 0 else capacity
                    wait.add(k, p, at, size, zlib.crc32(memoryview(ids)[4 * at : 4 * (at + size)]))
                    at += size
                if len(wait) >= buffer:
                    yield packed(False)
        if len(wait):
            yield packed(True)

    schema = f"{key} long, piece int, start long, length long, ids_crc32 long, bin long, fill int, offset long, offer boolean"
    return docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text).cast("string"), F.lit("")).alias(text)).mapInArrow(freed(work), schema)


def _merge(capacity: int, offers: int):
    """Pack the bins of one group as items: (bin, into, fill, base, offer); offer: the result goes to the next round."""

    def work(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("bin")
        b, o, fill = best_fit(g["fill"].tolist(), capacity)
        at, base, fill, items = np.array(b), np.array(o, np.int64), np.array(fill), g["bin"].to_numpy()
        lead = np.zeros(len(fill), np.int64)
        lead[at[base == 0]] = items[base == 0]
        nth = pd.Series(fill).groupby(fill).cumcount().to_numpy()
        offer = (fill < FULL * capacity) & (nth < offers)
        return pd.DataFrame({"bin": items, "into": lead[at], "fill": fill[at], "base": base, "offer": offer[at]})

    return work


def pack(docs: DataFrame, tokenizer: str, end: int = END_BYTE, capacity: int = LENGTH, key: str = "doc_id", text: str = "text", offers: int = OFFERS, buffer: int = BUFFER) -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of each piece."""
    spark = docs.sparkSession
    arrow_batches(spark)
    ws = Workspace(spark, "packing")
    pieces = ws.cut(_local(docs, tokenizer, end, capacity, key, text, offers, buffer), "pieces")
    part = F.shiftright("bin", 36).alias("part")
    level = ws.cut(pieces.where("offer and offset = 0").select("bin", "fill", part), "open0")
    moved = None
    top = level.agg(F.max("part")).first()[0]
    step, i = 1, 0
    while top is not None and (step == 1 or top // step > 0):
        step, i = step * FAN, i + 1
        group = F.floor(F.col("part") / step).cast("long").alias("g")
        done = level.withColumn("g", group).groupBy("g").applyInPandas(_merge(capacity, offers), "bin long, into long, fill int, base long, offer boolean")
        done = ws.cut(done, f"merge{i}")
        new = done.where("bin != into").select("bin", "into", "base")
        if moved is not None:  # a bin that moved into one that moves now goes on with it
            then = new.select(F.col("bin").alias("into"), F.col("into").alias("then"), F.col("base").alias("more"))
            old = moved.join(then, "into", "left").select("bin", F.coalesce("then", "into").alias("into"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
            new = old.unionByName(new)
        moved = ws.cut(new, f"moved{i}")
        level = done.where("offer and base = 0").select("bin", "fill", part)
    ws.keep("pieces", f"moved{i}")
    cols = [key, "piece", "start", "length", "ids_crc32"]
    if moved is None:
        return pieces.select(*cols, F.col("bin").alias("sequence_id"), "offset")
    # a packing moves its one small bin at most, so there are no more rows than partitions
    placed = pieces.join(F.broadcast(moved), "bin", "left")
    return placed.select(*cols, F.coalesce("into", "bin").alias("sequence_id"), (F.col("offset") + F.coalesce("base", F.lit(0))).alias("offset"))
