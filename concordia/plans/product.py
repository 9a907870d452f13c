"""From readings to the documents that hold a phrase: consensus, search, second chance, saving, summary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concordia.functions import similarity
from concordia.functions import text as T
from concordia.operators import consensus, guards
from concordia.sources import sinks

MIN_LETTERS = 30


def read_enough(docs: DataFrame) -> DataFrame:
    """docs with read: whether the text has letters enough to count as read."""
    return docs.withColumn("read", F.coalesce(T.letters(F.col("text")) >= MIN_LETTERS, F.lit(False)))


def unread(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """The documents that texts(doc_id, text) hasn't read, for which dearer readers are run."""
    return docs.join(read_enough(texts).where("read").select("doc_id").distinct(), "doc_id", "left_anti")


def searched(docs: DataFrame, phrase: str, ask: Callable[[str, str], str] | None = None) -> DataFrame:
    """(doc_id, text, read, matched, how) of docs(doc_id, text), a row for each.

    how: filter, if the phrase is near the text's words; model, if ask quoted it from a text that the filter missed; none. A document
    that isn't read can match only by the second chance; without a phrase every document that is read matches.
    """
    seen = read_enough(docs.select("doc_id", "text"))
    hits = similarity.fuzzy_phrase(seen.where("read"), phrase).select("doc_id", F.lit(True).alias("hit"))
    out = seen.join(hits, "doc_id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)) & F.col("read"))
    if ask is None or not phrase.strip():
        return out.select("doc_id", "text", "read", F.col("hit").alias("matched"), F.when(F.col("hit"), "filter").otherwise("none").alias("how"))
    missed = out.where(~F.col("hit") & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    more = guards.find_phrase(missed.select("doc_id", "text"), phrase, ask).select("doc_id", F.lit(True).alias("quoted"))
    how = F.when(F.col("hit"), "filter").when(F.col("quoted"), "model").otherwise("none")
    return out.join(more, "doc_id", "left").select("doc_id", "text", "read", (how != "none").alias("matched"), how.alias("how"))


def summary(found: DataFrame) -> DataFrame:
    """One row: documents in all, saved, saved by the model's quote, and left out."""
    return found.agg(F.count("*").alias("total"), F.count_if("matched").alias("saved"), F.count_if(F.col("how") == "model").alias("by_model"), F.count_if(~F.col("matched")).alias("skipped"))


def run(readings: DataFrame, phrase: str, path: str, chooser: guards.Chooser | None = None, ask: Callable[[str, str], str] | None = None) -> DataFrame:
    """Readings (doc_id, witness, text) to saved texts under path/texts and reports under path/reports; gives the summary.

    What is merged is written first, so neither searches nor sinks merge again.
    """
    docs = consensus.wide(readings)
    merged = consensus.merge(docs, chooser)
    merged.write.mode("overwrite").parquet(f"{path}/merged")
    merged = readings.sparkSession.read.schema(merged.schema).parquet(f"{path}/merged")
    sinks.write_reports(merged, f"{path}/reports", docs)
    found = searched(merged.select("doc_id", T.clean_text(F.col("text")).alias("text")), phrase, ask)
    found.write.mode("overwrite").parquet(f"{path}/found")
    found = readings.sparkSession.read.schema(found.schema).parquet(f"{path}/found")
    found.where("matched").select("doc_id", "text").write.mode("overwrite").parquet(f"{path}/texts")
    return summary(found)
