"""Decontamination against a plain model on random documents, and cases that templates alone would lose."""

import random

import pytest

from concordia.llm import decontam as D


def found(spark, docs, items):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").selectExpr("*", "1 AS _w", "2 AS h", "3 AS item_id").repartition(3)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {r["doc_id"]: r["item_ids"] for r in D.digest(df, bench).collect()}


def test_word_for_word_whatever_the_slots(spark):
    names = "Anna Bell 1901 Carl Dorn 1902 Emil Frey 1903 Gerd Hahn 1904 Ida Jost 1905"
    nouns = "Der Hund Max und die Katze Mia sahen im Garten Vogel Baum Haus Zaun Stein Weg Bach Feld Wald"
    long = " ".join(f"word{chr(97 + i % 26)}{i}" for i in range(30))
    part = " ".join(long.split()[7:23])  # 16 of 30 words
    few = " ".join(long.split()[7:18])
    got = found(spark, [f"before {names} after", f"vorher {nouns}, nachher", f"x y {part} z", f"x y {few} z"], [names, nouns, long])
    assert got == {0: [0], 1: [1], 2: [2], 3: []}


def test_signs_and_capitals_of_any_script(spark):
    item = "In Österreich zahlt Émile für €30 am Tag bei -5 Grad gern ein warmes Zimmer mit Blick auf den See"
    other = item.replace("Österreich", "Ägypten").replace("Émile", "Zoë").replace("€30", "€95").replace("-5", "-17")
    assert found(spark, [other, other.replace("warmes", "kaltes").replace("gern", "nie").replace("zahlt", "nimmt")], [item]) == {0: [0], 1: []}


def test_items_that_share_a_template(spark):
    items = [f"What does a ticket cost if {k} children and {k + 3} adults pay {9 * k} coins at the old gate" for k in range(2, 40)]
    got = found(spark, [f"so {items[4]} or", "a text of its own that shares not one window of words with any"], items)
    assert got[0] == list(range(38)) and got[1] == []  # each is the same question with other numbers


def plain(doc, item, n=D.WINDOW):
    """Windows of literal words that both hold, without case: what any match of a verbatim passage rests on."""
    words = lambda t: [w for w in (x.strip(D.SIGNS).lower() for x in t.split()) if w]
    a, b = words(doc), words(item)
    have = {tuple(a[i : i + n]) for i in range(len(a) - n + 1)}
    places = [i for i in range(len(b) - n + 1) if tuple(b[i : i + n]) in have]
    return len(places) / max(1, len(b) - n + 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_passages_against_a_plain_model(spark, seed):
    rng = random.Random(seed)
    pool = [f"{c}{k}" for k in range(400) for c in ("ab", "Cd", "5")]
    items = [" ".join(rng.choice(pool) for _ in range(rng.randrange(14, 45))) for _ in range(25)]
    docs = []
    for _ in range(60):
        item = rng.choice(items).split()
        at = rng.randrange(len(item) - 10)
        piece = item[at : at + rng.randrange(8, len(item))] if rng.random() < 0.6 else item
        own = [rng.choice(pool) for _ in range(rng.randrange(0, 200))]
        cut = rng.randrange(len(own) + 1)
        docs.append(rng.choice([str, str.upper, str.title])(" ".join(own[:cut] + piece + own[cut:])))
    got = found(spark, docs, items)
    for k, d in enumerate(docs):
        for i, item in enumerate(items):
            if plain(d, item) >= D.COVER:
                assert i in got[k]
            elif i in got[k]:  # by a run, or a template with slots; both need windows in common
                assert plain(d, item) > 0 or any(c.isupper() or c.isdigit() for c in item)


def test_empty_tables_and_rows(spark):
    item = "one two three four five six seven eight nine ten"
    assert found(spark, [None, "", "   ", item], [item, None, ""]) == {0: [], 1: [], 2: [], 3: [0]}
    df = spark.createDataFrame([(1, item), (1, item), (None, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (1, item)], "item_id long, text string")
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in D.digest(df, bench).collect()) == [(0, True), (1, False), (1, False)]
    assert D.digest(df, bench.limit(0)).where("kept").count() == 3 and D.digest(df.limit(0), bench).count() == 0
    rows = spark.createDataFrame([(1, item, "a"), (1, "other words", "b"), (None, item, "c"), (None, None, "d"), (2, "clean", "e")], "doc_id long, text string, uid string")
    kept = D.drop_contaminated(rows, bench)
    assert kept.columns == rows.columns and sorted(r["uid"] for r in kept.collect()) == ["b", "d", "e"]
    assert D.drop_contaminated(rows.limit(0), bench).count() == 0 and D.drop_contaminated(rows, bench.limit(0)).count() == 5
