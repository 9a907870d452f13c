"""Readers of documents and pages as plug-ins, and what comes of their output: page texts, word boxes.

A reader is any object that the executors can import; the library holds none that drives another program. It runs row by row in batches,
a failed row keeps its error in a column and ends nothing, and a lost executor repeats its batch.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from concordia.functions import text as T

#: Columns of a word box table as readers print it, by place; a line with fewer is no box.
TSV_COLUMNS, TSV = 12, {"left": 6, "top": 7, "width": 8, "height": 9, "conf": 10, "word": 11}
#: What ends a line of such a table.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


class Extractor(Protocol):
    """Reads one page or document. name: the witness that it is."""

    name: str

    def available(self) -> bool: ...

    def read(self, content: bytes) -> str: ...


class Renderer(Protocol):
    """Makes page images of a document; TimeoutError is tried again, other errors aren't."""

    def pages(self, content: bytes, dpi: int) -> Sequence[bytes]: ...


def available(extractors: Sequence[Extractor]) -> list[Extractor]:
    """Those that can run here; one that fails to say is not among them."""

    def can(e: Extractor) -> bool:
        try:
            return bool(e.available())
        except Exception:  # a reader's own failure, whatever it is
            return False

    return [e for e in extractors if can(e)]


def _tried(work: Callable[[], object], attempts: int = 1) -> tuple[object, str | None]:
    """(result, None), or (None, error); only a timeout is tried again."""
    for left in range(attempts - 1, -1, -1):
        try:
            return work(), None
        except TimeoutError as e:
            error = e
            if left:
                continue
        except Exception as e:  # a reader's own failure, whatever it is
            error = e
        break
    return None, f"{type(error).__name__}: {error}"


def render(docs: DataFrame, renderer: Renderer, attempts: int = 2) -> DataFrame:
    """(doc_id, page_no, png, error) of documents(doc_id, content, dpi); a document that fails has one row, without a page."""
    kind = dict(docs.dtypes)["doc_id"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, content, dpi in zip(b["doc_id"], b["content"], b["dpi"]):
                pages, error = _tried(lambda: list(renderer.pages(content, int(dpi))), attempts)  # noqa: B023  called at once
                rows += [(k, n, p, None) for n, p in enumerate(pages)] if error is None else [(k, None, None, error)]
            out = pd.DataFrame(rows, columns=["doc_id", "page_no", "png", "error"])
            out["page_no"] = out["page_no"].astype("Int32")
            yield out

    return docs.select("doc_id", "content", "dpi").mapInPandas(work, f"doc_id {kind}, page_no int, png binary, error string")


def prepared(pages: DataFrame, step: Callable[[bytes], bytes]) -> DataFrame:
    """pages(doc_id, page_no, png) with png as step makes it; where it fails the page stays as it was, and error tells why."""
    kind = dict(pages.dtypes)["doc_id"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = [_tried(lambda: step(p)) if p is not None else (None, None) for p in b["png"]]  # noqa: B023  called at once
            yield b.assign(png=[p if x is None else x for p, (x, _) in zip(b["png"], made)], error=[e for _, e in made])

    return pages.select("doc_id", "page_no", "png").mapInPandas(work, f"doc_id {kind}, page_no int, png binary, error string")


def extract(pages: DataFrame, extractors: Sequence[Extractor]) -> DataFrame:
    """(doc_id, page_no, witness, text, error) of each page by each reader that is available; a failed page has an empty text."""
    readers = available(extractors)
    kind = dict(pages.dtypes)["doc_id"]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, n, png in zip(b["doc_id"], b["page_no"], b["png"]):
                for e in readers:
                    text, error = _tried(lambda: e.read(png))  # noqa: B023  called at once
                    rows.append((k, n, e.name, text or "", error))
            out = pd.DataFrame(rows, columns=["doc_id", "page_no", "witness", "text", "error"])
            out["page_no"] = out["page_no"].astype("Int32")
            yield out

    return pages.select("doc_id", "page_no", "png").mapInPandas(work, f"doc_id {kind}, page_no int, witness string, text string, error string")


def joined_pages(texts: DataFrame) -> DataFrame:
    """(doc_id, witness, text) of (doc_id, page_no, witness, text): pages in order, a line feed between them, cleaned."""
    pages = F.sort_array(F.collect_list(F.struct("page_no", "text")))
    whole = F.array_join(F.transform(pages, lambda p: F.coalesce(p["text"], F.lit(""))), "\n")
    return texts.groupBy("doc_id", "witness").agg(whole.alias("t")).select("doc_id", "witness", T.clean_text(F.col("t")).alias("text"))


def tsv_boxes(tables: DataFrame) -> DataFrame:
    """Word boxes (page, seq, word, left, top, width, height, conf) of tables(page, tsv), the first line of which is a heading.

    Lines with too few columns, numbers that aren't, and blank words are left out. Nothing is quoted.
    """
    rows = tables.select("page", F.posexplode(F.split("tsv", LINE_ENDS, -1)).alias("seq", "line")).where("seq > 0")
    rows = rows.select("page", "seq", F.split("line", "\t", -1).alias("c")).where(F.size("c") >= TSV_COLUMNS)
    cell = lambda name: F.get("c", F.lit(TSV[name]))
    whole = [F.regexp_replace(cell(x), T.TRIM, "") for x in ("left", "top", "width", "height")]
    number = F.regexp_replace(cell("conf"), T.TRIM, "")
    fits = F.forall(F.array(*whole), lambda x: x.rlike(r"^[+-]?\d+$")) & number.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    word = F.regexp_replace(cell("word"), T.TRIM, "")
    out = rows.where(fits).select("page", "seq", word.alias("word"), *(x.try_cast("int").alias(name) for x, name in zip(whole, ("left", "top", "width", "height"))), number.try_cast("double").alias("conf"))
    return out.where("word <> '' and left is not null and top is not null and width is not null and height is not null")


_WHOLE, _NUMBER = re.compile(r"[+-]?[0-9]+"), re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")


def _boxes(tsv: str, min_conf: float) -> Iterator[tuple[int, int, int, int, int, str]]:
    """(top, seq, left, width, height, word) of tsv_boxes(), for one table."""
    for seq, line in enumerate(tsv.splitlines()):
        c = line.split("\t")
        if not seq or len(c) < TSV_COLUMNS:
            continue
        cells = [c[TSV[x]].strip() for x in ("top", "left", "width", "height")]
        conf, word = c[TSV["conf"]].strip(), c[TSV["word"]].strip()
        if word and _NUMBER.fullmatch(conf) and all(map(_WHOLE.fullmatch, cells)):
            top, left, width, height = map(int, cells)
            if all(-(1 << 31) <= x < 1 << 31 for x in (top, left, width, height)) and (min_conf <= 0 or float(conf) >= min_conf):
                yield top, seq, left, width, height, word


def page_rows(tables: Sequence[str], min_conf: float = 0) -> str | None:
    """The lines of sequence.layout() for one page's tables, in order; None without a word."""
    boxes = sorted(b for tsv in tables for b in _boxes(tsv, min_conf))
    if not boxes:
        return None
    half = (sorted(b[4] for b in boxes)[len(boxes) // 2] or 20) // 2
    rows: list[list[tuple]] = []
    last = None
    for top, seq, left, width, _, word in boxes:
        if last is None or abs(top - last) > max(6, half):
            rows.append([])
        rows[-1].append((left, top, seq, width, word))
        last = top
    out = []
    for row in rows:
        row.sort()
        pieces = [row[0][4]]
        for (left, _, _, _, word), (before, _, _, width, _) in zip(row[1:], row):
            gap = left - before - width
            pieces += ["" if gap <= 2 else "\t" if gap >= 4 * max(4, half) else " ", word]
        out.append("".join(pieces))
    return "\n".join(out)


def layout_pages(tables: DataFrame, min_conf: float = 0) -> DataFrame:
    """(page, text) of tables(page, tsv) of word boxes: layout_text() of tsv_boxes(), a page at once and without a row for each word."""

    @F.arrow_udf(StringType())
    def joined(pages: pa.Array) -> pa.Array:
        return pa.array([page_rows(p, min_conf) for p in pages.to_pylist()], pa.string())

    # not deterministic by name only: else the filter would be pushed below and the pages be laid out twice
    found = tables.where("tsv is not null").groupBy("page").agg(F.collect_list("tsv").alias("tsv")).select("page", joined.asNondeterministic()("tsv").alias("t")).where("t is not null")
    return found.select("page", T.strip_garbage(T.clean_text(F.col("t"))).alias("text"))
