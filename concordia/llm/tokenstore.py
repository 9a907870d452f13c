"""Token ids in binary shards with keyed access.

A shard holds documents in ascending key order: a header, a minimal perfect hash over its distinct keys, a 32-bit
fingerprint and the first document of each slot, the ids' offsets of each document, and the raw ids, little-endian unsigned
16-bit where all fit, else 32-bit. A lookup reads one displacement, one slot, one fingerprint and one slice: constant time. Shards
are uncompressed binary cells of a Parquet table in a shared folder, so that Spark's commit protocol guards them against lost
executors on any store that Spark can write. Row groups are about a shard each and carry its range of keys, so a keyed read loads
one shard, SHARD_IDS ids or one document, whatever the table's size.

Odd rows: a null or empty text has the end id alone; a null key sorts first and is found under None; rows that repeat a key
follow each other by hash of their text, over several shards if they are many, and are all found under it; a very long text makes a
shard by itself; an empty table makes no shard. Only key and text are read, whatever other columns there are.
"""

from __future__ import annotations

import struct
import zlib
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .hashing import mix
from .tokens import END_WORD, encoder
from .workspace import Workspace, arrow_batches, freed

MAGIC, HEAD = b"TOK2", struct.Struct("<4sIQQQQQ")
#: A shard is closed as it reaches so many ids or documents.
SHARD_IDS, SHARD_DOCS = 1 << 19, 4096

#: Keys that lookup() asks for at once.
BLOCK = 64
SCHEMA = (("part", pa.int32()), ("shard", pa.int32()), ("nulls", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("ids", pa.int64()), ("blob", pa.binary()))


def build_hash(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacements, slots): a minimal perfect hash of distinct int64 keys by hash and displace.

    Buckets of about four keys, largest first, try displacements until their keys meet free slots; buckets of one key take a
    free slot outright, stored as a negative number.
    """
    n = len(keys)
    seeds = np.zeros(max(1, (n + 3) // 4), np.int32)
    slots = np.full(n, -1, np.int64)
    if not n:
        return seeds, slots
    h = mix(keys.view(np.uint64))
    bucket = (h % np.uint64(len(seeds))).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    free = np.ones(n, bool)
    groups = sorted(np.split(order, cuts), key=len, reverse=True)
    spare = None
    for g in groups:
        if len(g) > 1:
            at = 1
            while True:
                tries = np.arange(at, at + 256, dtype=np.uint64)
                place = (mix(h[g][None, :] + tries[:, None] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)
                order_ = np.sort(place, axis=1)
                good = free[place].all(axis=1) & (order_[:, 1:] != order_[:, :-1]).all(axis=1)
                if good.any():
                    i = int(np.argmax(good))
                    seeds[bucket[g[0]]], slots[g] = at + i, place[i]
                    free[place[i]] = False
                    break
                at += 256
        else:
            if spare is None:
                spare = iter(np.flatnonzero(free).tolist())
            slots[g[0]] = next(spare)
            seeds[bucket[g[0]]] = -int(slots[g[0]]) - 1
    return seeds, slots


def slot_of(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    h = mix(keys.astype(np.int64).view(np.uint64))
    d = seeds[(h % np.uint64(len(seeds))).astype(np.int64)].astype(np.int64)
    far = mix(h + np.maximum(d, 0).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(max(n, 1))
    return np.where(d < 0, -d - 1, far.astype(np.int64))


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0xA5A5A5A55A5A5A5A)) >> np.uint64(32)).astype("<u4")


def pack(keys: list, payloads: list[bytes]) -> bytes:
    """One shard of documents whose keys ascend, None first."""
    nulls = sum(k is None for k in keys)
    named = np.array(keys[nulls:], np.int64)
    distinct, first = np.unique(named, return_index=True)
    seeds, slots = build_hash(distinct)
    marks, docs = np.zeros(len(distinct), "<u4"), np.zeros(len(distinct), "<u4")
    marks[slots], docs[slots] = fingerprint(distinct), first + nulls
    ends = np.cumsum([0] + [len(p) // 4 for p in payloads], dtype="<u8")
    ids = np.frombuffer(b"".join(payloads), "<u4")
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    head = HEAD.pack(MAGIC, nulls, len(keys), len(distinct), len(seeds), int(ends[-1]), width)
    return b"".join([head, seeds.astype("<i4").tobytes(), marks.tobytes(), docs.tobytes(), ends.tobytes(), named.astype("<i8").tobytes(), ids.astype(f"<u{width}").tobytes()])


class Shard:
    """Reader of one shard."""

    def __init__(self, blob: bytes):
        magic, self.nulls, self.n, self.m, r, n_ids, width = HEAD.unpack_from(blob)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = HEAD.size
        parts = []
        for kind, count in (("<i4", r), ("<u4", self.m), ("<u4", self.m), ("<u8", self.n + 1), ("<i8", self.n - self.nulls), (f"<u{width}", n_ids)):
            parts.append(np.frombuffer(blob, kind, count, at))
            at += parts[-1].nbytes
        self.seeds, self.marks, self.docs, self.ends, self.keys, self.ids = parts

    def find(self, keys: np.ndarray) -> np.ndarray:
        """First document of each key, or -1 where the fingerprint says that the shard has no such key."""
        if not self.m:
            return np.full(len(keys), -1, np.int64)
        s = slot_of(keys, self.seeds, self.m)
        return np.where(self.marks[s] == fingerprint(keys), self.docs[s].astype(np.int64), -1)

    def spans(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document of each key and the one after its last, both -1 where the shard has no such key. Keys aren't null."""
        first = self.find(keys)
        near = np.where(first < 0, 0, first - self.nulls)
        first = np.where((first >= 0) & (self.keys[near] == keys), first, -1) if len(self.keys) else first
        last = np.where(first < 0, -1, first + 1)
        for i in np.flatnonzero((first >= 0) & (last < self.n)):
            if self.keys[last[i] - self.nulls] == keys[i]:  # a repeated key
                last[i] = self.nulls + int(np.searchsorted(self.keys, keys[i], "right"))
        return first, last

    def payload(self, doc: int) -> np.ndarray:
        return self.ids[int(self.ends[doc]) : int(self.ends[doc + 1])].astype("<u4")

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of each document under key."""
        lo, hi = (0, self.nulls) if key is None else (int(x[0]) for x in self.spans(np.array([key], np.int64)))
        return [self.payload(k) for k in range(lo, hi)]


def write(docs: DataFrame, tokenizer: str, ws: Workspace, key: str = "doc_id", text: str = "text", end: int = END_WORD) -> DataFrame:
    """Shards (part, shard, nulls, low, high, ids, blob), sorted by key over all parts."""
    arrow_batches(docs.sparkSession)
    tail = np.array([end], "<u4").tobytes()

    def work(batches):
        from pyspark import TaskContext

        enc, part, keys, load, size, shard = encoder(tokenizer), TaskContext.get().partitionId(), [], [], 0, 0

        def row():
            named = [k for k in keys if k is not None]
            cells = [[part], [shard], [len(keys) - len(named)], [named[0] if named else None], [named[-1] if named else None], [size // 4], [pack(keys, load)]]
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(cells, SCHEMA)], [name for name, _ in SCHEMA])

        for b in batches:
            for k, t in zip(b.column("key"), b.column("text")):
                ids = enc.ids(t.as_py()) + tail
                if keys and size + len(ids) > 4 * SHARD_IDS or len(keys) >= SHARD_DOCS:
                    yield row()
                    keys, load, size, shard = [], [], 0, shard + 1
                keys.append(k.as_py())
                load.append(ids)
                size += len(ids)
        if keys:
            yield row()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # hash and number divide the rows of one key, however many there are; rows alike in key and text may change places
    dealt = dealt.withColumn("h", F.xxhash64("text")).withColumn("u", F.monotonically_increasing_id())
    order = [F.col("key").asc_nulls_first(), F.col("h"), F.col("u")]
    dealt = dealt.repartitionByRange(n, *order).sortWithinPartitions(*order).select("key", "text")
    kinds = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary"}
    shards = dealt.mapInArrow(freed(work), ", ".join(f"{name} {kinds[kind]}" for name, kind in SCHEMA))
    return ws.cut(shards, "shards", **{"compression": "none", "parquet.block.size": str(1 << 20), "parquet.page.size": str(1 << 20), "parquet.enable.dictionary": "false"})


def read(shards: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32) of each document, from the shards: every key is looked up in its shard's index.

    What comes to the driver is a sum for each part, whose number the settings bound.
    """
    sums = dict(shards.groupBy("part").agg(F.sum("ids")).collect())
    base, at = {}, 0
    for part in sorted(sums):
        base[part], at = at, at + sums[part]
    before = F.sum("ids").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = shards.select("part", "shard", "ids").withColumn("before", F.coalesce(before, F.lit(0))).drop("ids")

    def work(batches):
        for b in batches:
            for part, ahead, blob in zip(*(b.column(c) for c in ("part", "before", "blob"))):
                s = Shard(blob.as_py())
                wanted = np.unique(s.keys)
                first, last = s.spans(wanted)
                if (first < 0).any():
                    raise ValueError("the index misses a key")
                span = last - first
                found = np.concatenate([np.arange(s.nulls), np.repeat(first - np.cumsum(span) + span, span) + np.arange(span.sum())]).astype(np.int64)
                keys = pa.array([None] * s.nulls + np.repeat(wanted, span).tolist(), pa.int64())
                ends = s.ends.astype(np.int64)
                crc = np.array([zlib.crc32(s.payload(i).tobytes()) for i in found], np.int64)
                start = base[part.as_py()] + ahead.as_py() + ends[found]
                yield pa.RecordBatch.from_arrays([keys, pa.array(start), pa.array(ends[found + 1] - ends[found]), pa.array(crc)], [key, "start", "n_tokens", "ids_crc32"])

    few = shards.select("part").limit(100_001).count() <= 100_000
    placed = shards.join(F.broadcast(starts) if few else starts, ["part", "shard"])
    return placed.select("part", "before", "blob").mapInArrow(freed(work), f"{key} long, start long, n_tokens long, ids_crc32 long")


def lookup(shards: DataFrame, keys: list[int | None]) -> dict:
    """Ids of a stated list of keys, in blocks of BLOCK: the filter on ranges reaches the scan, so only shards that may hold one are read."""
    out: dict = {k: [] for k in keys}
    wanted = list(out)
    for lo in range(0, len(wanted), BLOCK):
        some = wanted[lo : lo + BLOCK]
        hits = [F.col("nulls") > 0 if k is None else (F.col("low") <= k) & (F.col("high") >= k) for k in some]
        for r in shards.where(reduce(or_, hits)).orderBy("part", "shard").toLocalIterator():
            s = Shard(bytes(r["blob"]))
            for k in some:
                out[k].extend(s.get(k))
    return out


def digest(docs: DataFrame, tokenizer: str) -> DataFrame:
    ws = Workspace(docs.sparkSession, "tokens")
    return read(write(docs, tokenizer, ws))
