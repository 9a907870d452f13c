"""Several readings of a document: base reading, line majority, agreement, error rates.

Odd rows: a null reading abstains; a line that no reading has is empty and not decided; lines are told apart by (doc_id, row_no), so rows
that repeat a document count again; null texts have no lines; an empty table gives an empty one. Ties go to the witness first in
WITNESSES.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concordia.functions import batch
from concordia.functions import text as T

WITNESSES = ("chrome", "photos", "tesseract")
#: Share, in sixteenths, of the lines that a synthetic reading has wrong.
LEVELS = {"chrome": "1", "photos": "3", "tesseract": "7"}


def spread(docs: DataFrame) -> DataFrame:
    """docs over all shuffle partitions if its files make fewer: line work is heavy for its bytes. A table of many files stays as it is."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.repartition(n, "doc_id") if docs.rdd.getNumPartitions() < n else docs


def synthesize(docs: DataFrame) -> DataFrame:
    """(doc_id, row_no, truth and a column for each witness): the document's lines with errors picked by md5, line counts kept.

    Errors are a wrong letter, lost full stops, Latin letters as the Cyrillic ones that look like them, and, for the last witness, no reading.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("row_no", "truth"))

    def noisy(w: str) -> Column:
        h = F.substring(F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.lit(w), F.col("row_no").cast("string"))), 1, 2)
        first, second = F.substring(h, 1, 1), F.substring(h, 2, 1)
        bad = F.when(first == "0", F.replace("truth", F.lit("e"), F.lit("c"))).when(second < "6", F.translate("truth", T.LATIN, T.CYRILLIC)).otherwise(F.replace("truth", F.lit("."), F.lit("")))
        read = F.when(first < LEVELS[w], bad).otherwise(F.col("truth"))
        return (F.when(h != "ff", read) if w == WITNESSES[-1] else read).alias(w)

    return lines.select("doc_id", "row_no", "truth", *(noisy(w) for w in WITNESSES))


def decide(rows: DataFrame, *keep: str) -> DataFrame:
    """rows with line and decided, and the columns keep: the largest group of equal keys wins if it has two members or stands alone.

    A null reading abstains. Within the group the spelling with the most Cyrillic letters wins, then priority. Keys are made only for
    rows whose readings differ; where all are one string, that string is the line.
    """
    won = rows.withColumn("_won", batch.decided_udf(*WITNESSES))
    return won.select("doc_id", "row_no", *keep, F.col("_won.line").alias("line"), F.col("_won.decided").alias("decided"))


def reassemble(lines: DataFrame) -> DataFrame:
    rows = F.sort_array(F.collect_list(F.struct("row_no", "line")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda r: r["line"]), "\n").alias("text"), F.count("*").alias("n_lines"), F.count_if("decided").alias("agreed"))


def base_witness(texts: DataFrame) -> DataFrame:
    """(doc_id, witness): the first by priority whose quality is half the best or more; texts has doc_id, witness, rank, quality."""
    best = F.max("quality").over(Window.partitionBy("doc_id"))
    return texts.withColumn("best", best).where((F.col("quality") > 0) & (2 * F.col("quality") >= F.col("best"))).groupBy("doc_id").agg(F.min_by("witness", "rank").alias("witness"))


def error_rates(rows: DataFrame, *readings: str) -> DataFrame:
    """(reading, errors, chars, exact, lines): per column of rows the edits to truth, truth's characters, and lines without an edit.

    Other characters than ASCII count as one and the same, so all engines measure alike; a null reading is an empty one.
    """
    each = F.transform(F.array(*map(F.lit, readings)), lambda r, i: F.struct(r.alias("reading"), F.get("_e", i).alias("e")))
    got = rows.withColumn("_e", batch.edits_udf("truth", *readings)).select(F.length(F.coalesce("truth", F.lit(""))).alias("n"), F.explode(each).alias("x")).select("n", "x.*")
    return got.groupBy("reading").agg(F.sum("e").alias("errors"), F.sum("n").alias("chars"), F.count_if(F.col("e") == 0).alias("exact"), F.count("*").alias("lines"))
