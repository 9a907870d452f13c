"""Shards against a plain best-fit-decreasing over whole groups, and the law of near equal bytes."""

import collections
import random
import zlib

import pytest

from concordia.llm import sharding as S

DATA = "/root/testdata/sf0.001"


def naive(sizes, shards, capacity):
    """Shard of each size, in order."""
    rooms = [capacity] * shards
    out = []
    for s in sizes:
        fits = [(r, k) for k, r in enumerate(rooms) if r >= s]
        r, k = min(fits) if fits else max((r, k) for k, r in enumerate(rooms))
        rooms[k] -= s
        out.append(k)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_runs_are_best_fit_decreasing(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.choice([8, 9, 20, 50, 51, 300, rng.randrange(8, 900)]) for _ in range(rng.randrange(1, 600))), reverse=True)
    shards = rng.choice([1, 3, 24])
    capacity = -(-sum(sizes) // shards)
    runs = S.best_fit_decreasing(sorted(collections.Counter(sizes).items(), reverse=True), shards, capacity)
    starts = [a for a, _ in runs] + [len(sizes)]
    assert [s for (a, s), b in zip(runs, starts[1:]) for _ in range(b - a)] == naive(sizes, shards, capacity)


def test_rooms_are_a_search_tree():
    rng = random.Random(1)
    rooms, plain = S.Rooms(), []
    for _ in range(3000):
        if plain and rng.random() < 0.45:
            size = rng.randrange(0, 120)
            fits = [x for x in plain if x >= (size, -1)]
            want = min(fits) if fits else max(plain)
            assert rooms.take(size) == want
            plain.remove(want)
        else:
            new = (rng.randrange(100), len(plain) * 1000 + rng.randrange(1000))
            if new not in plain:
                rooms.add(*new)
                plain.append(new)

    def depth(t):
        return 0 if t is None else 1 + max(depth(t[1]), depth(t[2]))

    assert depth(rooms.root) < 40


def dealt(spark, rows, shards=24):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS shard", "2 AS g", "3 AS n", "4 AS size", "5 AS u").repartition(5)
    got = S.deal(docs, shards).collect()
    plain = lambda t: t or ""
    assert collections.Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == collections.Counter((k, len(plain(t).encode()) + 8, zlib.crc32(plain(t).encode())) for k, t in rows)
    load, slots, homes = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        homes[r["text_crc32"]].add(r["shard"])
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    return load, homes


def test_whole_groups_in_near_equal_shards(spark):
    base = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r["doc_id"], r["text"]) for r in base] + [(1000 + k, f"small text {k} " * (k % 40)) for k in range(2000)] + [(None, "no key"), (7, None), (7, ""), (None, None)]
    load, homes = dealt(spark, rows, 6)
    assert max(load.values()) - min(load.values()) <= 60 and all(len(s) == 1 for s in homes.values())


def test_a_group_larger_than_a_shard_fills_shards(spark):
    rows = [(k, "a" * 5000) for k in range(300)] + [(1000 + k, f"{k} small") for k in range(200)] + [(5, "a" * 5000)] * 50
    load, homes = dealt(spark, rows)
    assert len(load) == 24 and max(load.values()) - min(load.values()) <= 5008
    assert sum(len(s) > 1 for s in homes.values()) == 1


def test_tiny_tables(spark):
    assert dealt(spark, [(1, None)], 24)[0] == {0: 8} or len(dealt(spark, [(1, None)], 24)[0]) == 1
    assert dealt(spark, [], 24)[0] == {}
    assert sum(dealt(spark, [(None, None)] * 500, 3)[0].values()) == 4000
