"""Shards of near equal bytes by best-fit-decreasing packing of indivisible groups.

Items are the groups of equal texts, all of them, largest first; each enters the tightest shard that has room, found in a balanced
tree of rooms; where none has, the emptiest takes it. Groups of one size are alike to best fit: the tightest shard takes them until it
has no room for another. So the driver packs counts by size, of which there are at most the root of twice all bytes, and what comes
out is a list of ranges over the groups in order of size. A group larger than a shard can't stay whole if shards are to be
equal: it goes first, and its rows, in order of key, are the items, so it fills one shard after another.

Odd rows: a null text is of 8 bytes, and all null texts form one group, with the empty ones; rows that repeat a key, and null keys, are
rows like any other; very long texts are measured whole; ties: groups of one size go by their hash, shards of one room by number; an
empty table gives an empty one. Only key and text are read, whatever other columns there are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, freed

EXTRA = 8
#: A group with one of so many parts of all rows goes to its rows by broadcast, so that no key of the join is hot.
HOT = 4096


class Rooms:
    """A treap of (room, shard): a search tree by room that its nodes' hashed priorities keep balanced."""

    def __init__(self, pairs=()):
        self.root = None
        for room, shard in pairs:
            self.add(room, shard)

    @staticmethod
    def _rank(shard: int) -> int:
        return (shard + 1) * 0x9E3779B97F4A7C15 % (1 << 64)

    def _split(self, t, key):
        """Nodes below key, and the others. A node is (key, left, right)."""
        if t is None:
            return None, None
        if t[0] < key:
            low, high = self._split(t[2], key)
            return (t[0], t[1], low), high
        low, high = self._split(t[1], key)
        return low, (t[0], high, t[2])

    def _join(self, a, b):
        if a is None or b is None:
            return a or b
        if self._rank(a[0][1]) > self._rank(b[0][1]):
            return (a[0], a[1], self._join(a[2], b))
        return (b[0], self._join(a, b[1]), b[2])

    def add(self, room: int, shard: int) -> None:
        low, high = self._split(self.root, (room, shard))
        self.root = self._join(self._join(low, ((room, shard), None, None)), high)

    def take(self, size: int) -> tuple[int, int]:
        """Takes out the tightest of size or more, else the largest."""
        low, high = self._split(self.root, (size, -1))
        t, way = (high, 1) if high else (low, 2)
        while t[way]:
            t = t[way]
        rest, top = self._split(self.root, t[0])
        _, top = self._split(top, (t[0][0], t[0][1] + 1))
        self.root = self._join(rest, top)
        return t[0]


def best_fit_decreasing(counts: list[tuple[int, int]], shards: int, capacity: int) -> list[tuple[int, int]]:
    """(first item, shard) of each run of items that go to one shard; counts has (size, number) in the order in which they are packed."""
    rooms = Rooms((capacity, s) for s in range(shards))
    runs, at = [], 0
    for size, n in counts:
        while n:
            room, shard = rooms.take(size)
            k = min(n, max(1, room // size))
            runs.append((at, shard))
            rooms.add(room - k * size, shard)
            at, n = at + k, n - k
    return runs


def _indexed(ws: Workspace, df: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """df with i, the place of each row in the order, from 0. What comes to the driver is a row for each partition."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    df = ws.cut(df.withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id()), name)
    starts, at = [], 0
    for r in df.groupBy("_part").agg(F.count("*").alias("n"), F.min("_pos").alias("low")).orderBy("_part").collect():
        starts.append((r["_part"], at - r["low"]))
        at += r["n"]
    move = df.sparkSession.createDataFrame(starts, "_part int, _move long")
    return df.join(F.broadcast(move), "_part").withColumn("i", F.col("_pos") + F.col("_move")).drop("_part", "_pos", "_move")


def _dealt(items: DataFrame, runs: list[tuple[int, int]], ahead: int, keep: str) -> DataFrame:
    """items with the shard of the run that holds their place i, after ahead others; keep: the other columns, as a schema."""
    model = items.sparkSession.sparkContext.broadcast((np.array([r[0] for r in runs], np.int64), np.array([r[1] for r in runs], np.int32)))
    names = [c.split()[0] for c in keep.split(", ")]

    def work(batches):
        first, shard = model.value
        for b in batches:
            at = np.searchsorted(first, b.column("i").to_numpy() + ahead, "right") - 1
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(shard[at], pa.int32())], [*names, "shard"])

    return items.select("i", *names).mapInArrow(freed(work), f"{keep}, shard int")


def deal(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of each row; law is bytes."""
    spark = docs.sparkSession
    ws = Workspace(spark, "shards")
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"), (F.octet_length(t) + EXTRA).cast("long").alias("size"), F.crc32(t.cast("binary")).alias("text_crc32"), F.xxhash64(t, F.octet_length(t)).alias("g"), F.monotonically_increasing_id().alias("u")
    )
    rows = ws.cut(rows, "rows")
    n, total = rows.agg(F.count("*"), F.sum("size")).first()
    groups = ws.cut(rows.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.max("size").alias("one")), "groups")
    capacity = -(-(total or 0) // shards)
    large = sorted((-r["bytes"], r["g"], r["one"], r["n"]) for r in groups.where(F.col("bytes") > capacity).collect())  # fewer than shards
    split = sum(x[3] for x in large)
    names = F.array(*(F.lit(x[1]) for x in large))
    sizes: dict[int, int] = dict(groups.where(F.col("bytes") <= capacity).groupBy("bytes").agg(F.count("*").alias("n")).collect())
    runs = best_fit_decreasing([(one, m) for _, _, one, m in large] + sorted(sizes.items(), reverse=True), shards, capacity)
    out = []
    cols = ["doc_id", "size", "text_crc32", "u", "shard"]
    rest = rows
    if large:
        rest = rows.where(~F.array_contains(names, F.col("g")))
        ordered = _indexed(ws, rows.where(F.array_contains(names, F.col("g"))).withColumn("nth", F.array_position(names, F.col("g"))), "split", "nth", "doc_id", "u")
        out.append(_dealt(ordered, runs, 0, "doc_id long, size long, text_crc32 long, u long"))
    if sizes:
        ordered = _indexed(ws, groups.where(F.col("bytes") <= capacity), "ordered", F.col("bytes").desc(), F.col("g"))
        placed = ws.cut(_dealt(ordered, runs, split, "g long, n long"), "placed")
        hot = placed.where(F.col("n") * HOT > n).select("g", "shard")  # fewer than HOT
        often = rest.join(F.broadcast(hot), "g")
        seldom = rest.join(F.broadcast(hot.select("g")), "g", "left_anti").join(placed.where(F.col("n") * HOT <= n).select("g", "shard"), "g")
        out += [often.select(*cols), seldom.select(*cols)]
    if not out:
        return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    dealt = out[0]
    for more in out[1:]:
        dealt = dealt.unionByName(more)
    dealt = _indexed(ws, dealt, "dealt", "shard", "doc_id", "u")
    starts = dealt.groupBy("shard").agg(F.min("i").alias("low"))
    ws.keep("dealt")
    return dealt.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("i") - F.col("low")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
