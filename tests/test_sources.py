"""Readers as plug-ins, tables of word boxes, settings, file discovery."""

import pytest
from pyspark.sql import functions as F

from concordia.sources import config, extract, files


class Upper:
    """Reads bytes as text, in capitals; some pages fail."""

    def __init__(self, name="upper", there=True):
        self.name, self.there = name, there

    def available(self):
        return self.there

    def read(self, content):
        if content == b"bad":
            raise ValueError("not a page")
        return content.decode().upper()


class Broken(Upper):
    def available(self):
        raise OSError("no such program")


class Pages:
    """A page for each line of the content. A document of slow times out once in each worker, one of dead always."""

    tries = 0

    def pages(self, content, dpi):
        if content == b"dead" or content == b"slow" and not Pages.tries:
            Pages.tries += 1
            raise TimeoutError("240 s")
        if content == b"odd":
            raise ValueError("encrypted")
        return [x + b"@%d" % dpi for x in content.split(b"\n")]


@pytest.fixture(autouse=True)
def by_value():
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    yield
    cloudpickle.unregister_pickle_by_value(sys.modules[__name__])


def test_readers_that_can_run():
    assert [e.name for e in extract.available([Upper("a"), Upper("b", False), Broken("c"), Upper("d")])] == ["a", "d"]


def test_extract_isolates_failures_and_joins_pages(spark):
    pages = spark.createDataFrame([(1, 1, b"second  page"), (1, 0, b"first"), (2, 0, b"bad"), (2, 1, b"good"), (3, 0, None)], "doc_id long, page_no int, png binary")
    got = extract.extract(pages, [Upper("a"), Upper("off", False), Upper("b")])
    rows = {(r["doc_id"], r["page_no"], r["witness"]): (r["text"], r["error"]) for r in got.collect()}
    assert len(rows) == 10 and rows[2, 0, "a"] == ("", "ValueError: not a page") and rows[2, 1, "b"] == ("GOOD", None) and rows[3, 0, "a"][0] == ""
    texts = {(r["doc_id"], r["witness"]): r["text"] for r in extract.joined_pages(got).collect()}
    assert texts[1, "a"] == "FIRST\nSECOND PAGE" and texts[2, "b"] == "GOOD" and texts[3, "a"] == ""
    assert extract.extract(pages.limit(0), [Upper()]).count() == 0 and extract.extract(pages, []).count() == 0


def test_render_tries_a_timeout_again(spark):
    docs = spark.createDataFrame([(1, b"x\ny", 300), (2, b"slow", 72), (3, b"odd", 72), (4, b"dead", 72)], "doc_id long, content binary, dpi int").coalesce(1)
    rows = extract.render(docs, Pages()).collect()
    got = {(r["doc_id"], r["page_no"]): (r["png"] and bytes(r["png"]), r["error"]) for r in rows}
    assert got == {(1, 0): (b"x@300", None), (1, 1): (b"y@300", None), (2, 0): (b"slow@72", None), (3, None): (None, "ValueError: encrypted"), (4, None): (None, "TimeoutError: 240 s")}


def test_a_page_that_cannot_be_prepared_stays(spark):
    pages = spark.createDataFrame([(1, 0, b"abc"), (1, 1, b"bad"), (1, 2, None)], "doc_id long, page_no int, png binary")

    def step(png):
        if png == b"bad":
            raise RuntimeError("no grid")
        return png[::-1]

    got = {r["page_no"]: (r["png"] and bytes(r["png"]), r["error"]) for r in extract.prepared(pages, step).collect()}
    assert got == {0: (b"cba", None), 1: (b"bad", "RuntimeError: no grid"), 2: (None, None)}


def table(*cells):
    return "level\tpage\n" + "\n".join("5\t1\t1\t1\t1\t1\t" + "\t".join(map(str, c)) for c in cells)


def test_word_boxes_of_a_table(spark):
    rows = [(1, table((10, 20, 40, 18, "91.5", "Hello"), (60, 21, 40, 18, -1, ' "world" '), ("x", 20, 40, 18, 9, "bad"), (10, 60, 30, 18, 88, "  "), (10, 62, 30, 18, "8e1", "next"), ("12.0", 62, 30, 18, 88, "no"), (10**12, 1, 1, 1, 1, "big"), (1, 2, 3))), (2, None), (3, ""), (4, "heading alone"), (5, table((1, 1, 9, 0, 5, "a"), (10, 1, 9, 0, 95, "b"), (60, 2, 9, 0, 95, "ccc!!!!"), (80, 2, 9, 0, 95, "~~"))), (6, table((1, 1, 9, 9, 5, "one")) + " " + table((1, 50, 9, 9, 5, "two")).split("\n")[1])]
    tables = spark.createDataFrame(rows, "page long, tsv string")
    boxes = extract.tsv_boxes(tables).orderBy("page", "seq").collect()
    assert [(r["page"], r["word"], r["conf"]) for r in boxes] == [(1, "Hello", 91.5), (1, '"world"', -1.0), (1, "next", 80.0), (5, "a", 5.0), (5, "b", 95.0), (5, "ccc!!!!", 95.0), (5, "~~", 95.0), (6, "one", 5.0), (6, "two", 5.0)]
    assert {r["page"]: r["text"] for r in extract.layout_pages(tables).collect()} == {1: 'Hello "world"\nnext', 5: "ab\tccc!", 6: "one\ntwo"}
    assert {r["page"]: r["text"] for r in extract.layout_pages(tables, 50).collect()} == {1: "Hello\nnext", 5: "b\tccc!"}


def test_settings():
    text = '{"phrase": "of the", "quorum": true, "chrome": false, "dynamic": 1, "llm_model": null, "max_gap": 3, "out_dir": "x"}'
    assert config.with_config(["run", "--out-dir", "mine"], text) == ["run", "--phrase", "of the", "--quorum", "--max-gap", "3", "--out-dir", "mine"]
    for bad in ("", "[1]", "{", "3"):
        assert config.with_config(["run", "x"], bad) == ["run", "x"]
    assert config.flag_value(["a", "--n", "5"], "--n", int) == 5 and config.flag_value(["a"], "--n") is None
    for argv in (["--n"], ["--n", "--m"], ["--n", "five"]):
        with pytest.raises(ValueError, match="--n needs a value"):
            config.flag_value(argv, "--n", int)
    assert config.reader_language(["eng", "ukr_best", "ukr"]) == "ukr_best" and config.reader_language(["eng"]) is None
    assert config.model_choice(["tiny:1b", "big:7b-x", "big:14b"], ["big:14b", "big:7b"]) == "big:14b" and config.model_choice([], ["a"]) is None
    assert config.Trigger(1, 50, True).fires and not any(t.fires for t in (config.Trigger(0, 90, True), config.Trigger(5, 49, True), config.Trigger(5, 60, False)))


def test_discovery(spark, tmp_path):
    for name in ("a.PDF", "sub/b.pdf", "sub/~$c.pdf", "d.Png", "e.txt", "sub/deep/f.x.TIFF"):
        path = tmp_path / "in" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"123")
    assert sorted(r["stem"] for r in files.discover(spark, str(tmp_path / "in")).collect()) == ["a", "b"]
    assert sorted((r["stem"], r["length"]) for r in files.discover(spark, str(tmp_path / "in"), files.IMAGES).collect()) == [("d", 3), ("f.x", 3)]
    sizes = spark.createDataFrame([(842.0,), (0.0,), (None,), (100.0,), (10000.0,)], "x double").select(files.safe_dpi(F.col("x")))
    assert [r[0] for r in sizes.collect()] == [282, 300, 300, 300, 72]


def test_pages_of_tables_are_the_layout_of_their_boxes(spark):
    import random

    from concordia.operators.sequence import layout_text

    rng = random.Random(9)
    cell = lambda: rng.choice(["x", "", " 7", "-3", "+4", "1.5", "99999999999"]) if rng.random() < 0.03 else str(rng.randrange(-20, 400))
    line = lambda: "\t".join(["5"] * 6 + [cell() for _ in range(4)] + [rng.choice(["90", "1e1", ".5", "-1", "x"]), rng.choice(["a", "b,", " ", "~~~", "wörd"])])
    pages = [(k, "level\n" + "\n".join(line() for _ in range(rng.choice([0, 1, 9, 90])))) for k in range(40)] + [(90, None)]
    tables = spark.createDataFrame(pages, "page long, tsv string")
    for least in (0, 20):
        got = {tuple(r) for r in extract.layout_pages(tables, least).collect()}
        assert got == {tuple(r) for r in layout_text(extract.tsv_boxes(tables), least).collect()} and got
    assert "Window" not in extract.layout_pages(tables)._jdf.queryExecution().toString()
