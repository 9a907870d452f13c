"""Quality rules: the verdict against EM and posteriors worked out in Python, and against labels."""

import math
from collections import Counter

from concordia.llm import quality_rules as Q

SF = "/root/testdata/sf0.01"


def votes_of(r):
    """Votes in the order of the rules, from the counts of one row."""
    n = max(1, r["n_words"])
    mean, signs, runs, lines, repeat, kinds = r["word_chars"] / n, r["n_symbols"] / n, r["n_sign_runs"] / n, r["n_dup_lines"] / max(1, r["n_lines"]), r["n_repeat_words"] / n, r["n_kinds"] / n
    rules = [
        (r["n_words"] >= 80, r["n_words"] < 50), (3 <= mean <= 9, mean < 2.5 or mean > 12), (signs <= 0.03, signs > 0.15), (runs <= 0.03, runs > 0.15), (lines <= 0.15, lines > 0.4),
        (repeat <= 0.1, repeat > 0.4), (kinds >= 0.3 or r["n_words"] > 2000 and kinds >= 0.1, kinds < 0.08),
    ]
    return tuple(-1 if bad else 1 if good else 0 for good, bad in rules)


def test_verdict_is_the_posterior_of_the_votes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "a b c " * 60_000), (-3, "a b c " * 60_000)], "doc_id long, text string"))
    rows = Q.judge(docs).collect()
    assert len(rows) == 1004
    made = [votes_of(r) for r in rows]
    prior, acc = Q.fit(sorted(Counter(made).items()))
    for r, v in zip(rows, made):
        odds = math.log(prior / (1 - prior)) + sum(math.log(g / (1 - b)) if x > 0 else math.log((1 - g) / b) for x, (g, b) in zip(v, acc) if x)
        assert math.isclose(r["posterior"], 1 / (1 + math.exp(-odds)), rel_tol=1e-9)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["posterior"] >= 0.5)
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in rows if labels.get(r["doc_id"]) == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.02 * len(bad)


def test_em_recovers_rules_of_known_accuracy():
    """Rules that are right on 95 %, 85 % and 70 % of good rows and 90 % of bad ones."""
    import random

    rng, rows = random.Random(6), []
    for _ in range(30_000):
        y = rng.random() < 0.7
        rows.append(tuple((1 if rng.random() < (a if y else 1 - b) else -1) if rng.random() < 0.9 else 0 for a, b in ((0.95, 0.9), (0.85, 0.9), (0.7, 0.9), (0.9, 0.8))))
    prior, acc = Q.fit(sorted(Counter(rows).items()), rounds=200)
    assert abs(prior - 0.7) < 0.03
    for (g, b), (a, c) in zip(acc, ((0.95, 0.9), (0.85, 0.9), (0.7, 0.9), (0.9, 0.8))):
        assert abs(g - a) < 0.04 and abs(b - c) < 0.06
    assert Q.fit([]) == (Q.PRIOR, [])


def test_clashing_names_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two three " * 40, "x", "y", 3)], "doc_id long, text string, _w string, kept string, n_words int")
    got = Q.judge(docs)
    assert got.columns[:2] == ["doc_id", "_w"] and got.columns.count("kept") == got.columns.count("n_words") == 1
    r = got.first()
    assert r["_w"] == "x" and r["n_words"] == 120 and r["kept"] is False
    assert Q.judge(docs.limit(0)).count() == 0 and Q.digest(docs.limit(0)).count() == 0
