"""Results to files, written by Spark's commit protocol."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concordia.functions import text as T
from concordia.functions.similarity import fuzzy_phrase
from concordia.operators.consensus import report_json

PRESETS, LABEL = 5, 60


def write_matches(docs: DataFrame, path: str, phrase: str = "") -> None:
    """Texts (doc_id, text) near whose words the phrase stands, all of them without one; null texts hold none."""
    hit = docs.join(fuzzy_phrase(docs, phrase), "doc_id", "left_semi") if phrase.strip() else docs
    hit.select("doc_id", "text").write.mode("overwrite").parquet(path)


def write_reports(merged: DataFrame, path: str, docs: DataFrame | None = None) -> None:
    """One JSON line a document: its readings, if docs has them, the report and the result."""
    report_json(merged, docs).select("value").write.mode("overwrite").text(path)


def training_pairs(pages: DataFrame) -> DataFrame:
    """(label, png, text) of pages(doc_id, png, text) whose text is good enough to train on."""
    label = F.substring(F.translate(F.col("doc_id").cast("string"), " /", "__"), 1, LABEL)
    return pages.where(T.good_training_text(F.col("text"))).select(label.alias("label"), "png", "text")


def write_preset(spark: SparkSession, path: str, index: int, name: str, score: float) -> None:
    row = {"best_preset_index": index, "name": name, "score": round(score, 4), "updated": datetime.now(timezone.utc).isoformat()}
    spark.createDataFrame([(json.dumps(row),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_preset(spark: SparkSession, path: str) -> int | None:
    """The remembered preset; None where there is none or its number is out of range."""
    from pyspark.errors import AnalysisException

    try:
        row = spark.read.schema("best_preset_index int").json(path).first()
    except AnalysisException:
        return None
    return row[0] if row and row[0] is not None and 0 <= row[0] < PRESETS else None
