"""Language by string kernels.

The blended-spectrum presence kernel of two texts is the number of n-grams (n from 1 to 4) that both hold, over the root of the
product of how many each holds. Nyström landmarks stand for the sample; kernel ridge regression, one against the rest, is solved on
them. The kernel is a product of presence vectors, so landmarks and coefficients fold into one matrix of n-gram by language, and
a batch of texts is scored by one matrix product.

Executors turn the sample's texts into presence bits, one task of an executor fits the model in blocks, and only landmarks and
coefficients reach the driver.

Odd rows: text that is null or has no letter is und with score 0; repeated rows score alike; a null language isn't learned from;
without any learned language all are und; very long texts are read whole, in blocks; ties go to the first language by name; an empty
table gives an empty one. n-grams hash into BUCKETS places, which the kernel is over. Only key, text and lang are read, whatever other
columns there are.
"""

from __future__ import annotations

import pickle
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .training import held_out
from .workspace import arrow_batches, freed

BUCKETS, GRAMS, BLOCK = 1 << 16, (1, 2, 3, 4), 1 << 17
#: Bounds of the sample: rows of a language, and rows and landmarks of all; with many languages each has its part of these.
ROWS, SAMPLE, LANDMARKS, ALL_LANDMARKS, RIDGE = 200, 12_800, 40, 640, 1e-3
#: Rows that the fit turns into numbers at once.
STEP = 128
_LETTER = re.compile(r"[^\W\d_]")
HAS_LETTER = r"\p{L}"


def presence(text: str) -> np.ndarray:
    """Zero-one vector of the hashed n-grams of the whole text, in lower case with runs of white space as one blank."""
    c = np.frombuffer(" ".join(text.lower().split()).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros(BUCKETS, np.uint8)
    for s in range(0, len(c), BLOCK):  # blocks overlap by the longest n-gram less one
        part = c[s : s + BLOCK + GRAMS[-1] - 1].astype(np.uint64)
        h = np.zeros(len(part), np.uint64)
        for n in GRAMS:
            m = len(part) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x100000001B3) + part[n - 1 :] + np.uint64(1)
            out[(h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64)] = 1
    return out


def _rooted(bits: np.ndarray) -> np.ndarray:
    """Presence vectors as numbers, each over the root of how many n-grams it holds."""
    x = np.unpackbits(bits, axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(1, x.sum(axis=1, keepdims=True)))


def fit(rows: list[tuple[str, bytes]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, bits of the landmarks, coefficients of landmark by language) from (lang, packed presence bits) rows."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return [], np.zeros((0, BUCKETS // 8), np.uint8), np.zeros((0, 0), np.float32)
    bits = np.stack([np.frombuffer(b, np.uint8) for _, b in rows])
    own = np.array([langs.index(r[0]) for r in rows])
    each = min(LANDMARKS, max(1, ALL_LANDMARKS // len(langs)))
    marks = np.concatenate([np.flatnonzero(own == g)[:each] for g in range(len(langs))])
    k_nm = np.empty((len(rows), len(marks)), np.float32)
    for m in range(0, len(marks), STEP):
        land = _rooted(bits[marks[m : m + STEP]]).T
        for i in range(0, len(rows), STEP):
            k_nm[i : i + STEP, m : m + STEP] = _rooted(bits[i : i + STEP]) @ land
    share = (1 / np.bincount(own, minlength=len(langs)))[own]  # languages weigh alike
    gram, right = RIDGE * k_nm[marks].astype(np.float64) + 1e-8 * np.eye(len(marks)), np.zeros((len(marks), len(langs)))
    for i in range(0, len(rows), STEP):
        k = k_nm[i : i + STEP].astype(np.float64)
        weighed = (k * share[i : i + STEP, None]).T
        gram += weighed @ k
        right += weighed @ np.eye(len(langs))[own[i : i + STEP]]
    return langs, bits[marks], np.linalg.solve(gram, right).astype(np.float32)


def folded(model: tuple[list[str], np.ndarray, np.ndarray]) -> np.ndarray:
    """The matrix of n-gram by language."""
    langs, bits, alpha = model
    out = np.zeros((BUCKETS, len(langs)), np.float32)
    for m in range(0, len(bits), STEP):
        out += _rooted(bits[m : m + STEP]).T @ alpha[m : m + STEP]
    return out


def learned(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The model of a sample of labelled rows, chosen by hash of the key: ROWS of each language, SAMPLE of all.

    The driver sees a count for each language and the ids of the sample; texts stay on executors, as 8 kB of bits a row.
    """
    ok = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    ok = ok.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(HAS_LETTER) & ~held_out())
    counts = ok.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(SAMPLE).collect()
    if not counts:
        return fit([])
    rows = min(ROWS, max(1, SAMPLE // len(counts)))
    spark = docs.sparkSession
    # of a frequent language, rows enter by chance at a rate that leaves enough of them; the exact number is then cut from these
    rate = spark.createDataFrame([(r["lang"], min(1.0, 3.0 * rows / r["count"] + 40 / r["count"])) for r in counts], "lang string, rate double")
    point = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 30)) / (1 << 30)
    some = ok.select("doc_id", "lang", point.alias("point")).join(F.broadcast(rate), "lang").where("point < rate")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("point", "doc_id"))
    few = some.distinct().withColumn("nth", nth).where(F.col("nth") <= rows).select("doc_id", "lang", "nth").collect()
    chosen = F.broadcast(spark.createDataFrame(few, "doc_id long, lang string, nth int"))

    def bits(batches):
        for b in batches:
            made = [np.packbits(presence(t.as_py())).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("nth"), pa.array(made, pa.binary())], ["lang", "nth", "bits"])

    def work(batches):
        got = sorted((g, n, x) for b in batches for g, n, x in zip(*(b.column(c).to_pylist() for c in ("lang", "nth", "bits"))))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([(g, x) for g, _, x in got]), pickle.HIGHEST_PROTOCOL)], pa.binary())], ["model"])

    # of rows that repeat a key one is learned from
    made = ok.join(chosen, ["doc_id", "lang"]).groupBy("lang", "nth", "doc_id").agg(F.min("text").alias("text")).mapInArrow(freed(bits), "lang string, nth int, bits binary")
    model = made.repartition(1).mapInArrow(freed(work), "model binary").collect()
    return pickle.loads(model[0]["model"]) if model else fit([])


def predict(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row."""
    spark = docs.sparkSession
    arrow_batches(spark, 64)
    model = spark.sparkContext.broadcast(learned(docs))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))

    def work(batches):
        langs, matrix = model.value[0], folded(model.value)
        for b in batches:
            texts = b.column("text").to_pylist()
            best, high = ["und"] * len(texts), np.zeros(len(texts))
            named = [i for i, t in enumerate(texts) if langs and _LETTER.search(t)]
            for at in range(0, len(named), 64):
                part = named[at : at + 64]
                x = np.stack([presence(texts[i]) for i in part])
                s = x.astype(np.float32) @ matrix / np.sqrt(np.maximum(1, x.sum(axis=1, dtype=np.int64)))[:, None]
                high[part] = np.clip(s.max(axis=1), 0, 1)
                for i, k in zip(part, s.argmax(axis=1)):
                    best[i] = langs[k]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(best, pa.string()), pa.array(high)], ["doc_id", "lang_pred", "score"])

    out = src.mapInArrow(freed(work), "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
