"""Classifiers: held-out accuracy, samples, odd rows."""

import random
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from concordia.llm import langid, quality_clf, toxicity, training

SF = "/root/testdata/sf0.01"
ODD = [(900001, None), (900002, ""), (900003, "   \n\t"), (900004, "one"), (900004, "one"), (None, "no key at all"), (900005, "Ab cD ef " * 200_000), (900006, "日本 é ² <|endoftext|> x"), (900007, "12 34 !!")]


@pytest.fixture(scope="module")
def tables(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(k, t, None, "odd", 0) for k, t in ODD], base.schema)
    return base.unionByName(odd).selectExpr("*", "'a' AS score", "'b' AS bits", "1 AS y", "2 AS nth").repartition(6).cache(), spark.read.parquet(f"{SF}/labels.parquet")


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = y == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / max(1, pos.sum() * (~pos).sum())


def test_language(spark, tables):
    docs, _ = tables
    got = langid.predict(docs).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all()
    m = got.merge(docs.select("doc_id", "lang").where("lang is not null").toPandas(), on="doc_id")
    assert (m["lang_pred"] == m["lang"])[m["held_out"]].mean() > 0.97
    und = got[got["lang_pred"] == "und"]
    assert set(und["doc_id"]) == {900001, 900002, 900003, 900007} and (und["score"] == 0).all()
    assert langid.predict(docs.limit(0)).count() == 0
    none = langid.predict(docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang").limit(5)).collect()
    assert {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}


def test_many_languages(spark):
    """80 languages: each can be predicted, and the fit stays small."""
    rng = random.Random(4)
    letters = [chr(c) for c in range(0x4E00, 0x4E00 + 800)]
    speak = {f"l{g:02d}": letters[g * 10 : g * 10 + 10] for g in range(80)}
    rows = [(k * 80 + g, " ".join("".join(rng.choices(own, k=5)) for _ in range(12)), name) for g, (name, own) in enumerate(speak.items()) for k in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(docs).toPandas().merge(docs.toPandas(), on="doc_id")
    assert (got["lang_pred"] == got["lang"]).mean() > 0.99 and got["lang_pred"].nunique() == 80
    sample = [(name, np.packbits(langid.presence(t)).tobytes()) for _, t, name in rows for _ in range(2)]
    tracemalloc.start()
    langid.fit(sample)
    assert len(sample) == 3_200 and tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_presence_does_not_depend_on_blocks(monkeypatch):
    text = "".join(chr(97 + i * i % 26) + " " * (i % 7 == 0) for i in range(5000))
    whole = langid.presence(text)
    monkeypatch.setattr(langid, "BLOCK", 64)
    assert (langid.presence(text) == whole).all()


def test_quality(spark, tables):
    docs, labels = tables
    got = quality_clf.score(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.5)).all()
    m = got.merge(labels.toPandas(), on="doc_id")
    held = m[m["held_out"]]
    assert (held["predicted"] == held["quality"]).mean() > 0.93 and auc(held["score"].to_numpy(), held["quality"].to_numpy()) > 0.97
    assert quality_clf.score(docs.limit(3), labels.limit(0)).where("score = 0").count() == 3
    assert quality_clf.score(docs.limit(0), labels).count() == 0


def test_toxicity(spark, tables):
    docs, labels = tables
    got = toxicity.score(docs, labels).toPandas()
    assert len(got) == docs.count() and got["score"].between(0, 1).all() and (got["predicted"] == (got["score"] >= 0.7)).all()
    m = got.merge(labels.toPandas().rename(columns={"toxic": "label"}), on="doc_id")
    clean = m[m["held_out"] & (m["label"] == 0)]
    assert clean["predicted"].mean() < 0.05
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == (~got["toxic"]).sum()
    assert toxicity.score(docs.limit(0), labels).count() == 0 and toxicity.drop_toxic(docs.limit(0), labels).count() == 0
    assert toxicity.score(docs.limit(4), labels.limit(0)).where("score = 0 and predicted = 0").count() == 4


def test_toxicity_of_held_out_rows(spark):
    """sf0.1, as smaller tables hold a handful of toxic rows."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).toPandas()
    m = got.merge(labels.toPandas().rename(columns={"toxic": "label"}), on="doc_id")
    held = m[m["held_out"]]
    assert auc(held["score"].to_numpy(), held["label"].to_numpy()) > 0.95
    assert held["predicted"][held["label"] == 1].mean() > 0.85 and held["predicted"][held["label"] == 0].mean() < 0.02


def test_sample_is_bounded_and_of_rows_that_may_be_learned_from(spark, tables):
    docs, labels = tables
    seen = training.trained(docs.unionByName(docs), labels, "quality", 50, lambda rows: rows)
    keys = [r[0] for r in seen]
    may = {r[0] for r in labels.where(~training.held_out()).select("doc_id").collect()}
    assert len(keys) == len(set(keys)) <= 50 and set(keys) <= may and keys == sorted(keys)
    assert training.trained(docs, labels.limit(0), "quality", 50, len) == 0


def test_scores_do_not_depend_on_blocks():
    rng = np.random.default_rng(1)
    rows = [(i, "en", " ".join(rng.choice(["good", "fine", "calm", "vile" if i % 2 else "nice"], 30)), i % 2) for i in range(200)]
    model = toxicity.train(rows)
    assert model.score([rows[1][2]])[0] > 0.5 > model.score([rows[0][2]])[0]
    long = "good " * 40_000 + "vile"
    assert model.score([long])[0] > model.score(["good " * 40_000])[0]
    assert model.score([""])[0] == model.score(["   "])[0]


def test_toxicity_learns_from_every_labelled_row(spark):
    """9,000 rows that may be learned from; the 6,000 that a hash puts first lack the word that makes the others toxic."""
    keys = spark.range(14_000).selectExpr("id AS doc_id").where(~training.held_out()).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(9_000)
    rng = random.Random(6)
    rows = []
    for nth, r in enumerate(keys.collect()):
        y = int(nth % 4 == 0)
        rows.append((r["doc_id"], None if nth % 3 else "en", " ".join(rng.choices(["good", "calm", "fine", "plain"], k=6) + [("vile" if nth < 6_000 else "zorgo") if y else "nice"]), y))
    every = spark.createDataFrame(rows, "doc_id long, lang string, text string, y int")
    docs, labels = every.select("doc_id", "text", "lang"), every.selectExpr("doc_id", "y AS toxic")
    asked = [(20_000 + k, f"good calm fine {w}", None) for k, w in enumerate(("nice", "vile", "zorgo"))]
    got = toxicity.score(docs.unionByName(spark.createDataFrame(asked, docs.schema)), labels).where("doc_id >= 20000").orderBy("doc_id").collect()
    assert got[0]["score"] < 0.3 and got[1]["score"] > 0.7 and got[2]["score"] > 0.7
    seen = [(r["doc_id"], r["lang"], r["text"], r["y"]) for r in training.learnable(docs, labels, "toxic", 1000).collect()]
    assert sorted(seen) == sorted((k, g or "", t, y) for k, g, t, y in rows)


def test_toxicity_of_several_tasks(spark, tables, monkeypatch):
    """Parameters averaged over tasks: the same whatever the parts of the table are, and about as good as those of one task."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    monkeypatch.setattr(toxicity, "PER_TASK", 700)
    a, b = toxicity.fitted(docs.repartition(3), labels), toxicity.fitted(docs.unionByName(docs).repartition(7), labels)
    assert all((x == y).all() for p, q in zip(a.tables, b.tables) for x, y in zip(p, q)) and a.thresholds == b.thresholds and a.bias == b.bias
    held = docs.where(training.held_out()).join(labels, "doc_id").toPandas()
    score, y = a.score(held["text"].fillna("").tolist()), held["toxic"].to_numpy()
    assert auc(score, y) > 0.95 and (score[y == 1] >= 0.7).mean() > 0.85 and (score[y == 0] >= 0.7).mean() < 0.02


def test_toxicity_learns_in_blocks(monkeypatch):
    rows = [(i, "en", "good calm fine " * (20 + i) + ("vile" if i % 2 else "nice"), i % 2) for i in range(60)]
    whole = toxicity.train(rows)
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    parts = toxicity.train(rows)
    for text in ("good calm fine " * 50 + "vile", "good calm"):
        assert abs(whole.score([text])[0] - parts.score([text])[0]) < 1e-3
    ids = toxicity.word_ids(rows[1][2])
    assert (toxicity._unpacked(toxicity._packed(ids), ids.shape[1]) == ids).all()
