"""Token shards against the tokenizers library, and keyed reads."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from concordia.llm import tokenstore as S
from concordia.llm.queries import tokenizer
from concordia.llm.workspace import Workspace

DATA = "/root/testdata/sf0.001"
PATH = tokenizer("word_bpe_49k.json")
ODD = [(900001, None), (900002, ""), (900003, "   \n\t"), (900004, "one"), (900004, "one"), (900004, "another"), (None, "no key at all"), (None, None), (900005, "Ab cD ef " * 200_000), (900006, "日本 é ² <|endoftext|> x"), (-5, "below zero")]


@pytest.fixture(scope="module")
def docs(spark):
    base = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").limit(120)
    many = spark.range(9000).selectExpr("42424242 AS doc_id", "concat('same key ', id % 7) AS text")
    return base.unionByName(spark.createDataFrame(ODD, base.schema)).unionByName(many).selectExpr("*", "1 AS part", "2 AS key", "3 AS h", "4 AS u").repartition(5).cache()


@pytest.fixture(scope="module")
def library(docs):
    tok = Tokenizer.from_file(PATH)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    made = {t: np.array(tok.encode(t, add_special_tokens=False).ids + [1], "<u4") for t in {t for _, t in rows}}
    return [(k, made[t]) for k, t in rows]


def test_digest(docs, library):
    got = sorted(S.digest(docs, PATH).collect(), key=lambda r: r["start"])
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == sorted(((k, len(x), zlib.crc32(x.tobytes())) for k, x in library), key=repr)
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]


def test_lookup_over_shards(spark, docs, library):
    shards = S.write(docs, PATH, Workspace(spark, "test"))
    assert shards.count() > 4 and shards.groupBy("part").count().count() > 1
    asked = [900004, 900001, None, 42424242, 7, 123456789, -5, *range(0, 130, 3)]
    got = S.lookup(shards, asked)
    plain = lambda arrays: sorted(a.tolist() for a in arrays)
    assert {k: plain(v) for k, v in got.items()} == {k: plain([x for j, x in library if j == k]) for k in asked}
    assert "PushedFilters: [Or" in shards.where((S.F.col("low") <= 5) | (S.F.col("nulls") > 0))._jdf.queryExecution().toString()


def test_empty(spark, docs):
    assert S.digest(docs.limit(0), PATH).count() == 0
    assert S.lookup(S.write(docs.limit(0), PATH, Workspace(spark, "test")), [1, None]) == {1: [], None: []}


@pytest.mark.parametrize("big", [5, 70_000])
def test_shard_round_trip(big):
    blob = S.pack([None, 3, 3, 7, 2**40], [np.array(x, "<u4").tobytes() for x in ([1], [2, 3], [], [big], [5, 6, 7])])
    s = S.Shard(blob)
    assert [a.tolist() for a in s.get(3)] == [[2, 3], []] and s.get(5) == [] and s.get(2**40)[0].tolist() == [5, 6, 7] and s.get(None)[0].tolist() == [1] and s.get(7)[0].tolist() == [big]
    assert S.Shard(S.pack([], [])).get(1) == [] and S.Shard(S.pack([None], [b""])).get(1) == []


@pytest.mark.parametrize("n", [0, 1, 2, 5, 300, 3000])
def test_minimal_perfect_hash(n):
    keys = np.arange(n, dtype=np.int64) * 977 - 50_000
    seeds, slots = S.build_hash(keys)
    assert sorted(slots) == list(range(n)) and (S.slot_of(keys, seeds, n) == slots).all()
    strangers = np.arange(10**6, 10**6 + 20_000, dtype=np.int64) * 3 + 1
    if n:
        s = S.Shard(S.pack(keys.tolist(), [b""] * n))
        assert (s.spans(strangers)[0] == -1).all() and (s.find(strangers) >= 0).mean() < 0.01
