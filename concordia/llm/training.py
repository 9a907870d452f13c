"""Labelled rows for the classifiers, all or a bounded sample, and scoring by partition."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import BROADCAST_IDS, arrow_batches, freed, give_back

#: A sample holds texts of LONGEST bytes at most, and ends at BYTES bytes; both bound what the training task holds in memory.
LONGEST, BYTES = 1 << 20, 64 << 20


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels no model may learn from; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _own(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y) of keys that may be learned from; a key with several labels counts as 1 if one of them is."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
    return own.groupBy("doc_id").agg(F.max("y").alias("y"))


def learnable(docs: DataFrame, labels: DataFrame, label: str, per_task: int) -> DataFrame:
    """(doc_id, lang, text, y) of every row with a label that may be learned from, dealt by hash of the row to one task for each per_task keys.

    Rows come in the order of that hash, equal rows side by side. Keys are broadcast only while there are at most BROADCAST_IDS.
    """
    own = _own(labels, label)
    n = own.count()
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    rows = docs.select(*cols).where(F.col("doc_id").isNotNull() & ~held_out()).join(F.broadcast(own) if n <= BROADCAST_IDS else own, "doc_id")
    rows = rows.withColumn("order", F.xxhash64("doc_id", "lang", "text"))
    tasks = max(1, -(-n // per_task))
    dealt = rows.repartition(tasks, "order").sortWithinPartitions("order", "doc_id", "lang", "text").drop("order")
    return dealt.coalesce(tasks)  # no more tasks than that, whatever deals the rows into more parts


def trained(docs: DataFrame, labels: DataFrame, label: str, bound: int, train: Callable[[list[tuple[int, str, str, int]]], object]) -> object:
    """What train makes of (doc_id, lang, text, label) of at most bound rows, chosen by hash of the key among all that may be learned from.

    One task of an executor trains, and only the model reaches the driver; a lost executor repeats that task, to the same model.
    A key with several labels counts as 1 if one of them is. The ids of the sample are broadcast: bound rows at most.
    """
    order = F.xxhash64("doc_id", F.lit(11))
    ids = _own(labels, label).orderBy(order, "doc_id").limit(bound).collect()
    if not ids:
        return train([])
    few = F.broadcast(docs.sparkSession.createDataFrame(ids, "doc_id long, y int"))
    cols = [F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")]
    arrow_batches(docs.sparkSession)

    def work(batches):
        rows, size = [], 0
        for b in batches:
            for row in zip(*(b.column(c) for c in ("doc_id", "lang", "text", "y"))):
                k, g, t, y = (x.as_py() for x in row)
                size += len(t.encode())
                if size <= BYTES and len(rows) < bound:
                    rows.append((k, g, t, y))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train(sorted(rows)), pickle.HIGHEST_PROTOCOL)], pa.binary())], ["model"])

    sample = docs.select(*cols).where(F.octet_length("text") <= LONGEST).join(few, "doc_id")
    sample = sample.groupBy("doc_id", "y").agg(F.min(F.struct("lang", "text")).alias("one")).select("doc_id", "one.*", "y")  # one row of those that repeat a key
    made = sample.repartition(1).sortWithinPartitions(order, "doc_id", "text").mapInArrow(freed(work), "model binary").collect()
    give_back(docs.sparkSession)
    return pickle.loads(made[0]["model"]) if made else train([])


def scored(docs: DataFrame, score: Callable[[list], object], *more: str) -> DataFrame:
    """docs(doc_id, text and the columns of more) with a score of each whole text in place of the text."""
    arrow_batches(docs.sparkSession)
    kinds = dict(docs.dtypes)
    cols = ["doc_id", *more]
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def work(batches):
        for b in batches:
            rates = np.asarray(score(b.column("text").to_pylist()), np.float64)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in cols), pa.array(rates)], [*cols, "score"])

    return src.mapInArrow(freed(work), ", ".join(["doc_id long", *(f"{c} {kinds[c]}" for c in more), "score double"]))
