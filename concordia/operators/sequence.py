"""Operators on ordered rows: layout, stability, rendezvous, sliding windows, table grids of pages.

Rows of one page, key or document are in order by their own columns, never by arrival. Keys that are null form a group like any other
in windows; an empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concordia.functions import text as T


def layout(boxes: DataFrame, min_conf: float = 0) -> DataFrame:
    """(page, row_id, line): words to lines by gaps and islands. A row starts where top moves from the word before by more than
    the tolerance; inside it the gap to the left neighbour decides on nothing, a blank or a tab.

    boxes has page, seq, word, left, top, width, height, and conf if min_conf is over 0, which drops words below it. All windows and
    the grouping are by page, so one shuffle serves them. Blank words and null places are left out; ties go by top, then seq.
    """
    by_page = Window.partitionBy("page")
    nth = F.row_number().over(by_page.orderBy("height", "seq"))
    b = boxes.where(F.trim("word") != "").where("left is not null and top is not null and width is not null and height is not null")
    b = b.where(F.col("conf") >= min_conf) if min_conf > 0 else b
    b = b.withColumn("nth", nth).withColumn("m", F.max(F.when(F.col("nth") == F.floor(F.count("*").over(by_page) / 2) + 1, F.col("height"))).over(by_page))
    half = F.floor(F.when(F.col("m") == 0, 20).otherwise(F.col("m")) / 2).cast("int")
    by_top = by_page.orderBy("top", "seq")
    b = b.withColumn("new", (F.abs(F.col("top") - F.lag("top").over(by_top)) > F.greatest(F.lit(6), half)).cast("int"))
    b = b.withColumn("row_id", F.sum(F.coalesce("new", F.lit(0))).over(by_top.rowsBetween(Window.unboundedPreceding, 0)))
    by_left = Window.partitionBy("page", "row_id").orderBy("left", "top", "seq")
    gap = F.col("left") - F.lag(F.col("left") + F.col("width")).over(by_left)
    sep = F.when(gap.isNull() | (gap <= 2), "").when(gap >= 4 * F.greatest(F.lit(4), half), "\t").otherwise(" ")
    b = b.withColumn("piece", F.concat(sep, F.col("word"))).withColumn("at", F.row_number().over(by_left))
    rows = F.sort_array(F.collect_list(F.struct("at", "piece")))
    return b.groupBy("page", "row_id").agg(F.array_join(F.transform(rows, lambda r: r["piece"]), "").alias("line"))


def layout_text(boxes: DataFrame, min_conf: float = 0) -> DataFrame:
    """(page, text): the lines of layout() in order, cleaned."""
    rows = F.sort_array(F.collect_list(F.struct("row_id", "line")))
    joined = F.array_join(F.transform(rows, lambda r: r["line"]), "\n")
    return layout(boxes, min_conf).groupBy("page").agg(joined.alias("t")).select("page", T.strip_garbage(T.clean_text(F.col("t"))).alias("text"))


def stable(polls: DataFrame, need: int = 2) -> DataFrame:
    """(key, fired_at): the first poll at which the same non-blank snapshot came need times in a row; a blank one breaks the run but
    is not forgotten. polls has key, seq and snap."""
    w = Window.partitionBy("key").orderBy("seq")
    last = F.last(F.when(F.col("snap") != "", F.col("snap")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    p = polls.withColumn("inc", F.coalesce((F.col("snap") != "") & (F.col("snap") == last), F.lit(False)).cast("int"))
    p = p.withColumn("run", F.sum(1 - F.col("inc")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.withColumn("same", F.sum("inc").over(Window.partitionBy("key", "run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
    return p.where((F.col("same") >= need - 1) & (F.col("inc") == 1)).groupBy("key").agg(F.min("seq").alias("fired_at"))


def outcome(polls: DataFrame, need: int = 2, quiet: float = 30, total: float = 120) -> DataFrame:
    """(key, how, text) of each key of polls(key, seq, snap, at), at being seconds since its first poll.

    settled: the snapshot that came need times in a row within total; quiet: nothing came within quiet, so the text is empty; total: the
    last that came within total.
    """
    p = polls.where(F.col("at") <= total)
    fired = stable(p, need).select("key", F.col("fired_at").alias("seq"))
    settled = p.join(fired, ["key", "seq"]).select("key", F.col("snap").alias("text"))
    came = F.col("snap") != ""
    seen = p.groupBy("key").agg(F.coalesce(F.min(F.when(came, F.col("at"))) <= quiet, F.lit(False)).alias("early"), F.max_by("snap", F.when(came, F.col("seq"))).alias("last"))
    out = seen.join(settled, "key", "left")
    how = F.when(~F.col("early"), "quiet").when(F.col("text").isNotNull(), "settled").otherwise("total")
    return out.select("key", how.alias("how"), F.when(how == "quiet", "").when(how == "settled", F.col("text")).otherwise(F.coalesce("last", F.lit(""))).alias("text"))


def rendezvous(reports: DataFrame, witnesses: int) -> DataFrame:
    """(key, ready_at): when all witnesses have reported; of a witness's reports the first counts. reports has key, witness, seq."""
    first = reports.groupBy("key", "witness").agg(F.min("seq").alias("seq"))
    return first.groupBy("key").agg(F.count("*").alias("n"), F.max("seq").alias("ready_at")).where(F.col("n") == witnesses).select("key", "ready_at")


def gathered(reports: DataFrame, active: Sequence[str], dead: Sequence[str] = ()) -> DataFrame:
    """(key, witness, text, seq) of each key for which all active witnesses have reported or died; reports has key, witness, seq, text.

    A witness's first report counts; a dead one's missing report is the empty text, without a seq. Reports of others are left out.
    """
    first = reports.where(F.col("witness").isin(*active)).groupBy("key", "witness").agg(F.min(F.struct("seq", "text")).alias("r"))
    came = F.map_from_entries(F.collect_list(F.struct("witness", "r")))
    grid = first.groupBy("key").agg(came.alias("came"))  # as many entries as there are witnesses
    ready = F.lit(True)
    for w in active:
        ready = ready & (F.lit(w in dead) | F.map_contains_key("came", w))
    got = F.col("came")[F.col("witness")]
    rows = grid.where(ready).select("key", "came", F.explode(F.array(*map(F.lit, active))).alias("witness"))
    return rows.select("key", "witness", F.coalesce(got["text"], F.lit("")).alias("text"), got["seq"].alias("seq"))


def windows(docs: DataFrame, size: int = 2500, step: int = 2200) -> DataFrame:
    """(doc_id, start, chunk): overlapping windows; the one that reaches the end is the last."""
    t = docs.select("doc_id", F.regexp_replace("text", "[ \t]+", " ").alias("t")).withColumn("n", F.length("t")).where("n > 0")
    t = t.select("doc_id", "t", F.explode(F.sequence(F.lit(0), F.greatest(F.col("n") - size + step - 1, F.lit(0)), F.lit(step))).alias("start"))
    return t.select("doc_id", "start", F.substring("t", F.col("start") + 1, F.lit(size)).alias("chunk"))


def _gaps(lines: DataFrame, low: int) -> DataFrame:
    """lines(page, y) with gap to the next one, ok (within a quarter of the page's median gap) and run, over gaps above low. One shuffle by page."""
    by_y = Window.partitionBy("page").orderBy("y")
    g = lines.where("y is not null").select("page", "y").withColumn("gap", F.lead("y").over(by_y) - F.col("y"))
    g = g.withColumn("n", F.count_if(F.col("gap") > 0).over(Window.partitionBy("page")) + 1).where(F.col("gap") > low)  # equal lines are one
    g = g.withColumn("med", F.percentile("gap", F.lit(0.5)).over(Window.partitionBy("page")))
    g = g.withColumn("off", (F.abs(F.col("gap") - F.col("med")) > 0.25 * F.col("med")).cast("int"))
    return g.withColumn("run", F.sum("off").over(by_y.rowsBetween(Window.unboundedPreceding, 0)))


def regularity(lines: DataFrame, low: int = 5) -> DataFrame:
    """(page, longest): the longest run of gaps within a quarter of their median. lines has page and y.

    Gaps of low or less are no rows of a table; under four lines or three gaps there is no grid, and the run is 0.
    """
    g = _gaps(lines, low)
    runs = g.groupBy("page", "run").agg(F.count_if(F.col("off") == 0).alias("n"), F.count("*").alias("gaps"), F.max("n").alias("lines"))
    best = runs.groupBy("page").agg(F.max("n").alias("n"), F.sum("gaps").alias("gaps"), F.max("lines").alias("lines"))
    kept = best.select("page", F.when((F.col("gaps") >= 3) & (F.col("lines") >= 4), F.col("n")).otherwise(0).alias("longest"))
    return lines.select("page").distinct().join(kept, "page", "left").select("page", F.coalesce("longest", F.lit(0)).alias("longest"))


def line_height(lines: DataFrame, pages: DataFrame, low: int = 5) -> DataFrame:
    """(page, height): the median gap above low between a page's lines; without four lines and three such gaps, a fiftieth of its width, 20 at least.

    lines has page and y, pages has page and width.
    """
    g = _gaps(lines, low).groupBy("page").agg(F.count("*").alias("gaps"), F.max("n").alias("lines"), F.max("med").alias("med"))
    fits = (F.col("gaps") >= 3) & (F.col("lines") >= 4)
    height = F.when(fits, F.floor("med")).otherwise(F.greatest(F.lit(20), F.floor(F.col("width") / 50)))
    return pages.join(g, "page", "left").select("page", height.cast("int").alias("height"))


def header_end(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, header): where the longest run of regular gaps, the first of equals, begins; all above is the header.

    Under five lines it is 12 % of the page's height; without a run of three gaps, the third line. pages has page and height.
    """
    g = _gaps(lines, 0)
    runs = g.where("off = 0").groupBy("page", "run").agg(F.count("*").alias("k"), F.min("y").alias("y"))
    best = runs.groupBy("page").agg(F.max_by("y", F.struct("k", -F.col("y"))).alias("start"), F.max("k").alias("k"))
    ends = lines.where("y is not null").select("page", "y").distinct().groupBy("page").agg(F.sort_array(F.collect_list("y")).alias("ys"))
    out = pages.join(ends, "page", "left").join(best, "page", "left")
    few = F.coalesce(F.size("ys"), F.lit(0)) < 5
    return out.select("page", F.when(few, F.floor(F.col("height") * 0.12)).when(F.col("k") >= 3, F.col("start")).otherwise(F.get("ys", F.lit(2))).cast("int").alias("header"))


def strips(lines: DataFrame, pages: DataFrame, rows: int = 10, overlap: int = 1, least: int = 20) -> DataFrame:
    """(page, strip, top, bottom): a page below its header in strips of so many rows of the table, each sharing overlap rows with the next.

    Strips lower than least are left out. Without rows enough, equal pieces of about 18 % of the height that share a tenth.
    """
    head = pages.join(header_end(lines, pages), "page")
    ys = lines.where("y is not null").select("page", "y").distinct().groupBy("page").agg(F.sort_array(F.collect_list("y")).alias("ys"))
    p = head.join(ys, "page", "left").withColumn("ys", F.filter(F.coalesce("ys", F.array().cast("array<int>")), lambda y: (y >= F.col("header")) & (y <= F.col("height")) & (y >= 0)))
    m, step = F.size("ys"), max(1, rows - overlap)
    last = F.ceil(F.greatest(m - 1 - rows, F.lit(0)) / step).cast("int")  # the strip that reaches the last line ends them
    tables = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(F.get("ys", k * step).alias("top"), F.get("ys", F.least(k * step + rows, m - 1)).alias("bottom")))
    tables = F.filter(tables, lambda x: x["bottom"] - x["top"] >= least)
    body = F.col("height") - F.col("header")
    n = F.greatest(F.lit(1), F.bround(body / (F.col("height") * 0.18)).cast("int"))
    size = F.floor(body / n).cast("int")
    cut = F.floor(size * 0.1).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(F.greatest(F.col("header"), F.col("header") + k * size - F.when(k > 0, cut).otherwise(0)).alias("top"), F.when(k == n - 1, F.col("height")).otherwise(F.col("header") + (k + 1) * size).alias("bottom")))
    out = p.select("page", F.posexplode(F.when(m >= rows + 1, tables).otherwise(pieces)).alias("strip", "x"))
    return out.select("page", "strip", F.col("x.top").cast("int").alias("top"), F.col("x.bottom").cast("int").alias("bottom"))


def peaks(profile: list[float] | np.ndarray, length: int, apart: int) -> list[int]:
    """Places of a profile's lines: maxima of the smoothed profile within apart, of a twentieth of length or more, the strongest first, none nearer
    than apart to one taken; of five or more, those of two fifths of their median or more.
    """
    raw = np.asarray(profile, np.float64)
    if not len(raw) or raw.max() <= 0:
        return []
    smooth = np.convolve(raw, np.full(3, 1 / 3), mode="same").astype(np.float32)[: len(raw)]
    wide = np.pad(smooth, apart, constant_values=-np.inf)
    around = np.lib.stride_tricks.sliding_window_view(wide, 2 * apart + 1).max(axis=1)
    spots = np.flatnonzero((smooth >= around - 1e-3) & (smooth >= 0.05 * length))
    taken: list[int] = []
    for at in spots[np.argsort(-smooth[spots], kind="stable")].tolist():
        near = bisect_left(taken, at - apart + 1)
        if near == len(taken) or taken[near] >= at + apart:
            insort(taken, at)
    if len(taken) >= 5:
        least = 0.4 * float(np.median(smooth[taken]))
        taken = [at for at in taken if smooth[at] >= least]
    return taken


def projection_peaks(profiles: DataFrame, apart: int = 8) -> DataFrame:
    """(page, y) of the lines of each page's profile; profiles has page, profile (array of numbers) and length."""

    def work(batches):
        for b in batches:
            found = [(k, y) for k, p, n in zip(b["page"], b["profile"], b["length"]) if p is not None for y in peaks(p, int(n), max(apart, int(n) // 400))]
            yield pd.DataFrame(found, columns=["page", "y"])

    return profiles.select("page", "profile", "length").mapInPandas(work, f"page {dict(profiles.dtypes)['page']}, y int")


def best_preset(scores: DataFrame) -> DataFrame:
    """(key, preset): the preset with the best score, the least one on ties."""
    return scores.groupBy("key").agg(F.max_by("preset", F.struct("score", -F.col("preset"))).alias("preset"))
