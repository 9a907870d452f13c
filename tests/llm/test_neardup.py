"""Near duplicates against brute force: crowded lists, copies with edits, odd rows."""

import random
import re

import numpy as np

from concordia.llm import neardup
from concordia.llm.workspace import Workspace


def sets_of(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)})) if x]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """Component of each distinct key by all pairs."""
    ids = sorted({k for k, _ in rows if k is not None})
    comp = {k: k for k in ids}

    def find(k):
        while comp[k] != k:
            k = comp[k]
        return k

    made = [(k, sets_of(t)) for k, t in rows if k is not None]
    links = 0
    for i, (a, x) in enumerate(made):
        for b, y in made[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                links += a != b
                p, q = find(a), find(b)
                comp[max(p, q)] = min(p, q)
    return {k: find(k) for k in ids}, links


def crowded(seed=5):
    """Documents of one shared passage with more or less of their own, and families of copies with edits, near the limit on both sides."""
    rng = random.Random(seed)
    word = lambda: "w%d" % rng.randrange(10**6)
    passage = [word() for _ in range(120)]
    texts = [" ".join(passage + [word() for _ in range(rng.randrange(8, 60))]) for _ in range(150)]
    for size in (40, 300, 900):
        base = [word() for _ in range(size)]
        for k in range(70):
            copy = list(base)
            for _ in range(rng.randrange(0, max(2, size // 22))):
                copy[rng.randrange(size)] = word()
            texts.append(" ".join(copy + (passage if k % 5 == 0 else [])))
    texts += [" ".join(word() for _ in range(rng.randrange(1, 30))) for _ in range(20)]
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


def result(docs):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.classes(docs).collect()), key=repr)


def expected(rows):
    comp, _ = brute(rows)
    return sorted(((k, len(sets_of(t)), comp.get(k), k is None or comp[k] == k) for k, t in rows), key=repr)


def test_crowded_lists_lose_no_link(spark):
    rows = crowded()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert len(rows) > 300 and brute(rows)[1] > 1000
    assert result(docs) == expected(rows)


def test_exact_lists_alone_find_all_pairs(spark):
    rows = crowded(8)[:260]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ws = Workspace(spark, "test")
    sets = ws.cut(neardup._sets(docs), "sets")
    lists = neardup._banded(ws.cut(neardup._postings(sets), "posts"), 75)
    pairs = neardup._cross(neardup._apart(ws, lists, spark.createDataFrame([], "doc_id long, comp long")))
    got = {(r["a"], r["b"]) for r in pairs.collect()}
    made = [(k, sets_of(t)) for k, t in rows]
    want = {(min(a, b), max(a, b)) for i, (a, x) in enumerate(made) for b, y in made[:i] if x != y and 100 * len(x & y) >= 75 * len(x | y)}
    assert want and want <= got


def test_least_shared_bounds_the_tail():
    from math import comb

    for k in (neardup.K, 200):
        low = neardup.least_shared(k)
        assert sum(comb(k, i) * 0.75**i * 0.25 ** (k - i) for i in range(low)) < 1e-10


def test_repeated_keys_and_clashing_names(spark):
    one, two = "a b c d e f g h i j k l m n o p", "z y x w v u t s r q p o n m l k"
    rows = [(5, one), (5, two), (7, one), (9, two), (None, one), (11, ""), (12, None), (12, None), (2**62 + 5, one), (-(2**62) - 9, "lone text")]
    docs = spark.createDataFrame([(k, t, 1, 2, 3) for k, t in rows], "doc_id long, text string, uid int, row int, comp int")
    assert result(docs) == expected(rows) and result(docs.limit(0)) == []
    assert result(docs.where("doc_id < 100")) == expected([r for r in rows if r[0] is not None and r[0] < 100])


def test_drop_near_leaves_one_row_of_a_group(spark):
    one = "a b c d e f g h i j k l m n o p"
    long = " ".join(f"w{i}" for i in range(300_000))  # many hash blocks
    rows = [(5, one), (5, one), (7, one.upper()), (None, one), (None, "other words"), (None, "other words"), (8, ""), (8, ""), (9, None), (1, long), (2, long + " x"), (4, "p o n m")]
    docs = spark.createDataFrame([(k, t, "u", [k]) for k, t in rows], "doc_id long, text string, uid string, row array<long>").repartition(3)
    out = neardup.drop_near(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], (r["text"] or "")[:8]) for r in out.collect()), key=repr)
    assert got == sorted([(7, one.upper()[:8]), (None, "other wo"), (8, ""), (8, ""), (9, ""), (1, long[:8]), (4, "p o n m")], key=repr)
    assert neardup.drop_near(docs.limit(0)).count() == 0
    assert neardup.drop_near(docs.where("doc_id in (5, 7)")).count() == 1


def test_hashes_do_not_depend_on_blocks():
    text = "é" * 200_000 + " " + "ab cd\tef " * 60_000
    assert len(neardup.shingles(text)) == len(sets_of(text)) and np.all(np.diff(neardup.shingles(text)) > 0)
