"""Packing against the tokenizers library, piece by piece, and its number of sequences against bounds."""

import collections
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from concordia.llm import packing
from concordia.llm.queries import tokenizer

DATA = "/root/testdata/sf0.001"
PATH = tokenizer("byte_bpe_50k.json")
ODD = [(900001, None), (900002, ""), (900003, "   \n\t"), (900004, "one"), (900004, "one"), (None, "no key at all"), (None, None), (900005, "Ab cD ef " * 9000), (900006, "日本 é ² <|endoftext|> x")]


@pytest.fixture(scope="module")
def library():
    tok = Tokenizer.from_file(PATH)
    return lambda text: np.array(tok.encode(text or "", add_special_tokens=False).ids + [0], "<u4")


def check(got, rows, library, capacity):
    """Every piece as the library gives it, and gapless places in sequences of capacity at most."""
    want = collections.Counter()
    for k, t in rows:
        ids = library(t)
        head = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(head, len(ids) + 1, capacity)]
        for p, (x, y) in enumerate(zip(cuts, cuts[1:])):
            want[k, p, x, y - x, zlib.crc32(ids[x:y].tobytes())] += 1
    assert collections.Counter(tuple(r)[:5] for r in got) == want
    placed = collections.defaultdict(list)
    for r in got:
        placed[r["sequence_id"]].append((r["offset"], r["length"]))
    for x in placed.values():
        at = 0
        for offset, length in sorted(x):
            assert offset == at
            at += length
        assert at <= capacity
    return [sum(n for _, n in x) for x in placed.values()]


def test_pieces_and_sequences(spark, library):
    base = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    docs = base.unionByName(spark.createDataFrame(ODD, base.schema)).selectExpr("*", "'x' AS bin", "1 AS fill", "2 AS offset", "true AS offer").repartition(6)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    full = check(packing.pack(docs, PATH).collect(), rows, library, 2048)
    assert len(full) <= sum(full) / 2048 * 1.05 + 2
    assert packing.pack(docs.limit(0), PATH).count() == 0


@pytest.mark.parametrize("offers, buffer", [(10**9, 10**9), (packing.OFFERS, packing.BUFFER), (8, 40)])
def test_bounds_of_what_rounds_see_cost_no_sequence(spark, library, offers, buffer):
    """Small documents over 20 partitions: three rounds. At most one sequence is half empty, for any bounds."""
    base = spark.read.parquet(f"{DATA}/documents.parquet").selectExpr("doc_id", "substr(text, 1, cast(40 + doc_id * 37 % 300 AS int)) AS text")
    base = base.unionByName(base.selectExpr("doc_id + 10000 AS doc_id", "substr(text, 1, cast(20 + doc_id * 13 % 150 AS int)) AS text")).repartition(20, "doc_id").cache()
    rows = [(r["doc_id"], r["text"]) for r in base.collect()]
    full = check(packing.pack(base, PATH, capacity=128, offers=offers, buffer=buffer).collect(), rows, library, 128)
    assert sum(2 * n <= 128 for n in full) <= 1 and len(full) <= sum(full) / 128 * 1.12 + 2


def test_many_half_full_bins_and_a_few_small_ones(spark, library):
    """Documents of 70 of 128 tokens can't be paired; each small one still finds a place beside one, and the small ones share."""
    docs = spark.createDataFrame([(k, " the" * (69 if k % 50 else 20)) for k in range(3000)], "doc_id long, text string").repartition(12, "doc_id")
    full = check(packing.pack(docs, PATH, capacity=128, buffer=100).collect(), [(r["doc_id"], r["text"]) for r in docs.collect()], library, 128)
    assert len(full) == 2940


def test_best_fit_leaves_one_small_bin():
    rng = random.Random(3)
    for _ in range(50):
        sizes = [rng.randrange(1, 129) for _ in range(rng.randrange(1, 300))]
        bins, offsets, filled = packing.best_fit(sizes, 128)
        assert sum(filled) == sum(sizes) and max(filled) <= 128 and sum(2 * f <= 128 for f in filled) <= 1
        assert all(offsets[i] + sizes[i] <= filled[b] for i, b in enumerate(bins))
