"""Toxicity by a small convolutional network over hashed word embeddings, trained in numpy.

Words hash into a table of embeddings; filters of several widths run over the whole text; the most of each goes into a
logistic unit. For scoring, embedding and filters fold into one table for each place in a filter, so a position costs a few
row sums. Every labelled row that may be learned from is: four in five make the network, the fifth the thresholds of the operator's
own verdict, one for each language, which never enter a score. Tasks learn side by side, and their parameters are averaged after each epoch.

Odd rows: a null or empty text scores as a text of one unknown word; repeated rows score alike; a null or new language takes the
common threshold; very long texts are learned from and scored whole, in blocks; of labelled rows that repeat a key, each different one is learned from; a score at a threshold is rejected; without labels of both kinds every
score is the share of label 1, or 0; an empty table gives an empty one. Only key, text and lang are read, whatever other columns
there are.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from . import hashing as H
from .training import held_out, learnable, scored
from .workspace import arrow_batches, freed, give_back

BUCKETS, DIM, WIDTHS, FILTERS = 1 << 16, 12, (1, 2, 3), 8
#: A word's embedding is the sum of its own and of those of its first so many bytes, so that new forms of a word are known.
HEADS = (4, 6)
EPOCHS, RATE = 6, 0.1
#: One labelled row in so many sets thresholds only; under FEWEST rows there is no network.
KEPT_BACK, FEWEST = 5, 20
#: Labelled keys that a task learns from, on average.
PER_TASK = 1 << 13
PREDICT = 0.7
CUTS = np.arange(0.3, 0.91, 0.05)
#: Places of a text that are worked out at once.
BLOCK = 16384
#: Parameters by part, and which places each filter covers; filters of all widths have as many places, those past their width stay 0.
SHAPES = ((BUCKETS, DIM), (WIDTHS[-1], DIM, FILTERS * len(WIDTHS)), (FILTERS * len(WIDTHS),), (FILTERS * len(WIDTHS),), (1,))
SIZE = sum(math.prod(s) for s in SHAPES)
INSIDE = np.arange(WIDTHS[-1])[:, None] < np.repeat(WIDTHS, FILTERS)
#: Parameters go from tasks to their means in pieces of so many.
PIECE = 1 << 16
PIECES = -(-SIZE // PIECE)


def word_ids(text: str) -> np.ndarray:
    """Buckets of each word and of its heads, a column for each place; at least one place per widest filter, bucket 0 is no word."""
    found = H.tokens(text.lower().encode(), H.ALNUM, H.ASCII_LOWER, HEADS)
    h = np.stack([found[0], *found[4:]])
    out = np.zeros((len(h), max(h.shape[1], WIDTHS[-1])), np.int32)
    out[:, : h.shape[1]] = (h >> np.uint64(20)) % np.uint64(BUCKETS - 1) + np.uint64(1)
    return out


@dataclass
class Model:
    prior: float = 0.0
    tables: list[list[np.ndarray]] = field(default_factory=list)
    out: np.ndarray | None = None
    bias: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def score(self, texts: list[str]) -> np.ndarray:
        if not self.tables:
            return np.full(len(texts), self.prior)
        return np.array([self.rate(word_ids(text)) for text in texts], np.float64)

    def rate(self, ids: np.ndarray) -> float:
        """The score of one text by its buckets."""
        most = []
        for w, parts in zip(WIDTHS, self.tables):
            best = None
            for s in range(0, ids.shape[1] - w + 1, BLOCK):  # blocks that overlap by w - 1, for very long texts
                n = min(BLOCK, ids.shape[1] - w + 1 - s)
                r = 0
                for k in range(w):
                    for row in ids:
                        r = r + parts[k][row[s + k : s + k + n]]
                r = r.max(axis=0)
                best = r if best is None else np.maximum(best, r)
            most.append(np.maximum(best, 0))
        return 1 / (1 + math.exp(-min(max(self.bias + float(np.concatenate(most) @ self.out), -30), 30)))


def _parts(flat: np.ndarray) -> list[np.ndarray]:
    """Views of all parameters in one row of numbers: embeddings, filters by place, their constants, weights of the filters, constant."""
    out, at = [], 0
    for shape in SHAPES:
        out.append(flat[at : at + math.prod(shape)].reshape(shape))
        at += math.prod(shape)
    return out


def _start(share: float, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Parameters before the first row, and their sums of squared gradients."""
    rng = np.random.default_rng(seed)
    flat = np.zeros(SIZE, np.float32)
    emb, filt, _, out, bias = _parts(flat)
    emb[:] = rng.normal(0, 0.1, emb.shape)
    filt[:] = rng.normal(0, 0.3, filt.shape) * INSIDE[:, None, :]
    out[:] = rng.normal(0.3, 0.1, out.shape)
    bias[:] = np.log((share + 1e-3) / (1 - share + 1e-3))
    return flat, np.full(SIZE, 1e-2, np.float32)


def _tops(ids: np.ndarray, emb: np.ndarray, filt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most of each filter over a text and the first place of it; in blocks, so memory follows the block and not the text."""
    n, best, place = ids.shape[1], None, None
    for s in range(0, n - min(WIDTHS) + 1, BLOCK):
        part = ids[:, s : s + BLOCK + WIDTHS[-1] - 1]
        e = emb.take(part[0], axis=0, mode="clip")
        for row in part[1:]:
            e += emb.take(row, axis=0, mode="clip")
        m = min(BLOCK, n - s)
        r = e[:m] @ filt[0]
        for k in range(1, WIDTHS[-1]):
            r[: len(e) - k] += (e[k:] @ filt[k])[:m]
        for j, w in enumerate(WIDTHS):  # windows that reach past the end
            r[max(0, n - w + 1 - s) :, j * FILTERS : (j + 1) * FILTERS] = -np.inf
        at = r.argmax(axis=0)
        top = r[at, np.arange(len(at))]
        if best is None:
            best, place = top, at
        else:
            place = np.where(top > best, at + s, place)
            best = np.maximum(best, top)
    return best, place


def learn(flat: np.ndarray, sums: np.ndarray, docs: Iterable[tuple[np.ndarray, int]], share: float) -> None:
    """Adagrad on logistic loss in place, document by document; the gradient of a maximum reaches its own window only."""
    (emb, filt, fb, out, bias), (g_emb, g_filt, g_fb, g_out, g_bias) = _parts(flat), _parts(sums)
    weight = (0.5 / max(1 - share, 0.05), 0.5 / max(share, 0.05))
    for ids, y in docs:
        a, at = _tops(ids, emb, filt)
        a = a + fb
        z = np.maximum(a, 0)
        p = 1 / (1 + np.exp(-np.clip(z @ out + bias[0], -30, 30)))
        d = np.float32((p - y) * weight[y])
        grad = d * z + np.float32(1e-4) * out
        da = d * out * (a > 0)
        g_out += grad * grad
        out -= RATE * grad / np.sqrt(g_out)
        g_bias += d * d
        bias -= RATE * d / np.sqrt(g_bias)
        live = np.flatnonzero(da)
        if not len(live):
            continue
        da, own = da[live], INSIDE[:, live].T  # live filters by place
        spots = np.where(own, at[live][:, None] + np.arange(WIDTHS[-1]), 0)
        gf = (sum(emb[row[spots]] for row in ids) * own[:, :, None] * da[:, None, None]).transpose(1, 2, 0)
        ge = (filt[:, :, live] * da).transpose(2, 0, 1)[own]
        g = g_filt[:, :, live] + gf * gf
        g_filt[:, :, live] = g
        filt[:, :, live] -= RATE * gf / np.sqrt(g)
        g_fb[live] += da * da
        fb[live] -= RATE * da / np.sqrt(g_fb[live])
        hit, which = np.unique(ids[:, spots[own]], return_inverse=True)
        to = (which.ravel() == np.arange(len(hit))[:, None]).astype(np.float32)  # sums by bucket, as a bucket may be hit several times
        ge = np.tile(ge, (len(ids), 1))
        g = g_emb[hit] + to @ (ge * ge)
        g_emb[hit] = g
        emb[hit] -= RATE * (to @ ge) / np.sqrt(g)


def _model(flat: np.ndarray, prior: float) -> Model:
    emb, filt, fb, out, bias = _parts(flat)
    tables = []
    for j, w in enumerate(WIDTHS):
        own = slice(j * FILTERS, (j + 1) * FILTERS)
        tables.append([emb @ filt[k][:, own] + (fb[own] / (1 + len(HEADS)) if k == 0 else 0) for k in range(w)])
    return Model(prior, tables, out.copy(), float(bias[0]))


def train(rows: list[tuple[int, str, str, int]], seed: int = 5) -> Model:
    """The model and thresholds of rows at hand, in one process."""
    y_all = np.array([r[3] for r in rows])
    if len(rows) < FEWEST or y_all.min() == y_all.max():
        return Model(prior=float(y_all.mean()) if len(rows) else 0.0)
    back = np.arange(len(rows)) % KEPT_BACK == KEPT_BACK - 1
    docs = [word_ids(r[2]) for r in rows]
    fit = np.flatnonzero(~back)
    share = float(y_all[fit].mean())
    flat, sums = _start(share, seed)
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        learn(flat, sums, ((docs[i], int(y_all[i])) for i in rng.permutation(fit)), share)
    model = _model(flat, float(y_all.mean()))
    counts: Counter = Counter()
    for i in np.flatnonzero(back):
        counts[rows[i][1], rows[i][3], _step(model.rate(docs[i]))] += 1
    model.thresholds = _thresholds(counts)
    return model


def _packed(ids: np.ndarray) -> bytes:
    return pa.compress(ids.astype("<u2").tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    rows = 1 + len(HEADS)
    return np.frombuffer(pa.decompress(data, 2 * rows * n, "zstd"), "<u2").reshape(rows, n)


def _tokenized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, y, back, n, ids) of rows in the order of learning; of equal rows, which lie side by side, one."""
    last = None
    for b in batches:
        out = []
        for row in zip(*(b.column(c) for c in ("doc_id", "lang", "text", "y", "back"))):
            k, g, t, y, back = (x.as_py() for x in row)
            if (k, g, t) != last:
                ids = word_ids(t)
                out.append((g, y, back, ids.shape[1], _packed(ids)))
                last = (k, g, t)
        cols = zip(*out) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.string(), pa.int32(), pa.bool_(), pa.int64(), pa.binary()))], ["lang", "y", "back", "n", "ids"])


def fitted(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of every labelled row that may be learned from: one in KEPT_BACK, by hash, sets the thresholds, all others the network.

    Each task of an epoch learns from its own rows, PER_TASK keys on average, on from the parameters of the epoch before; then each parameter
    becomes its mean over the tasks that moved it. Hashes of rows alone deal and order them, so machines, cores and lost executors change nothing.
    Words as buckets stay on the disks of executors meanwhile. The driver holds the parameters of one epoch, 6 MB.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    dealt = learnable(docs, labels, "toxic", PER_TASK).withColumn("back", F.pmod(F.xxhash64("doc_id", F.lit(12)), F.lit(KEPT_BACK)) == KEPT_BACK - 1)
    kept = dealt.mapInArrow(freed(_tokenized), "lang string, y int, back boolean, n long, ids binary").persist(StorageLevel.DISK_ONLY)
    try:
        return _fitted(spark, kept)
    finally:
        kept.unpersist()
        give_back(spark)


def _fitted(spark: SparkSession, kept: DataFrame) -> Model:
    n, ones, fit, fit_ones = kept.agg(F.count("*"), F.sum("y"), F.count_if(F.expr("not back")), F.count_if(F.expr("not back and y = 1"))).first()
    if n < FEWEST or ones in (0, n):
        return Model(prior=ones / n if n else 0.0)
    share = fit_ones / max(1, fit)
    flat, sums = _start(share)
    for epoch in range(EPOCHS):
        now = spark.sparkContext.broadcast((flat, sums))

        def work(batches, now=now, epoch=epoch):
            before, (flat, sums) = now.value[1], (x.copy() for x in now.value)
            task = rng = None
            for b in batches:
                if rng is None and b.num_rows:  # named by its first row, as numbers of tasks may follow where blocks lie
                    task = zlib.crc32(b.column("ids")[0].as_py())
                    rng = np.random.default_rng((task, epoch))
                elif not b.num_rows:
                    continue
                y, n, ids = b.column("y").to_pylist(), b.column("n").to_pylist(), b.column("ids")
                learn(flat, sums, ((_unpacked(ids[i].as_py(), n[i]), y[i]) for i in rng.permutation(len(y))), share)
            moved = sums != before
            for at in range(0, SIZE, PIECE):
                m = moved[at : at + PIECE]
                if m.any():
                    both = [np.where(m, x[at : at + PIECE], np.float32(0)).tobytes() for x in (flat, sums)]
                    yield pa.RecordBatch.from_arrays([pa.array([at // PIECE], pa.int32()), pa.array([task], pa.int64()), *(pa.array([x], pa.binary()) for x in both)], ["piece", "task", "flat", "sums"])

        def mean(batches):
            now, total = None, None
            for b in batches:
                for piece, x, g in zip(b.column("piece").to_pylist(), b.column("flat"), b.column("sums")):
                    x, g = (np.frombuffer(v.as_py(), np.float32) for v in (x, g))
                    if piece != now:
                        if now is not None:
                            yield _of_tasks(now, total)
                        now, total = piece, np.zeros((3, len(x)))
                    total += (x, g, g > 0)
            if now is not None:
                yield _of_tasks(now, total)

        made = kept.where("not back").select("y", "n", "ids").mapInArrow(freed(work), "piece int, task long, flat binary, sums binary")
        made = made.repartition(PIECES, "piece").sortWithinPartitions("piece", "task").mapInArrow(mean, "piece int, flat binary, sums binary")
        flat, sums = flat.copy(), sums.copy()
        for row in made.collect():
            at = slice(row["piece"] * PIECE, (row["piece"] + 1) * PIECE)
            for whole, part in ((flat, row["flat"]), (sums, row["sums"])):
                part = np.frombuffer(part, np.float32)
                whole[at] = np.where(np.isnan(part), whole[at], part)
        now.destroy()
        del made
        spark._jvm.System.gc()  # so that Spark removes the shuffled parameters of this epoch from the executors' disks
    model = _model(flat, ones / n)
    shared = spark.sparkContext.broadcast(model)

    def steps(batches):
        for b in batches:
            at = [_step(shared.value.rate(_unpacked(x.as_py(), m))) for x, m in zip(b.column("ids"), b.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("y"), pa.array(at, pa.int32())], ["lang", "y", "step"])

    counts = kept.where("back").select("lang", "y", "n", "ids").mapInArrow(freed(steps), "lang string, y int, step int").groupBy("lang", "y", "step").count().collect()
    shared.destroy()
    model.thresholds = _thresholds({(r["lang"], r["y"], r["step"]): r["count"] for r in counts})
    return model


def _of_tasks(piece: int, total: np.ndarray) -> pa.RecordBatch:
    """Means over the tasks that moved a parameter; NaN where none did."""
    with np.errstate(invalid="ignore"):
        both = [(x / total[2]).astype(np.float32).tobytes() for x in total[:2]]
    return pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), *(pa.array([x], pa.binary()) for x in both)], ["piece", "flat", "sums"])


def _step(score: float) -> int:
    """How many of CUTS the score reaches."""
    return int(np.searchsorted(CUTS, score, "right"))


def _thresholds(counts: dict[tuple[str, int, int], int]) -> dict[str, float]:
    """Of all rows, as "", and of each language, from the numbers of rows by language, label and step."""
    by: dict[str, np.ndarray] = {"": np.zeros((2, len(CUTS) + 1))}
    for (lang, y, step), n in counts.items():
        for g in {"", lang}:
            by.setdefault(g, np.zeros((2, len(CUTS) + 1)))[y, step] += n
    return {g: _threshold(x) for g, x in by.items()}


def _threshold(rows: np.ndarray) -> float:
    """Of the cuts from 0.3 to 0.9 the one with the best F1, nearest to the default if several are; the default for under 10 positives.

    rows: numbers of rows by label and step.
    """
    if rows[1].sum() < 10:
        return PREDICT
    above = rows[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]  # rows that reach each cut
    f1 = 2 * above[1] / np.maximum(1, above.sum(axis=0) + rows[1].sum())
    return float(round(min((-f, abs(c - PREDICT), c) for f, c in zip(f1, CUTS))[2], 2))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, toxic): predicted by the fixed cut, toxic by the threshold of the row's language."""
    model = fitted(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = scored(docs.select("doc_id", "text", "lang"), lambda texts: shared.value.score(texts), "lang")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"), _rejected(model).alias("toxic"))


def _rejected(model: Model):
    cut = F.lit(model.thresholds.get("", PREDICT))
    langs = defaultdict(list)
    for lang, t in model.thresholds.items():
        if lang:
            langs[t].append(lang)
    for t, own in langs.items():  # a branch for each cut, however many languages there are
        cut = F.when(F.col("lang").isin(own), t).otherwise(cut)
    return F.col("score") >= cut


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows and columns of docs, without those that the threshold of their language rejects."""
    model = fitted(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    arrow_batches(docs.sparkSession)

    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.asarray(shared.value.score(texts.to_pylist()), np.float64))

    rate = F.arrow_udf(freed(work), "double", ArrowUDFType.SCALAR_ITER)
    row = F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("row")
    rated = docs.select(row, F.col("lang").cast("string").alias("lang"), rate(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("score"))
    return rated.where(~_rejected(model)).select("row.*")
