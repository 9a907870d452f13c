"""Quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Features of a whole text: words and pairs of words, each once, scaled by their number's root; and n-grams of word shapes (kind,
length, whether the word returns at once), by the power of two of their share. A score is a sparse dot product.

Odd rows: a null or empty text has the bias feature alone; repeated rows score alike; very long texts are scored whole; a score at the
cut counts as 1; without labels of both kinds every score is the share of label 1, or 0; an empty table gives an empty one. Only key and
text are read, whatever other columns there are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .training import held_out, scored, trained

BUCKETS = 1 << 18
SAMPLE, EPOCHS = 6000, 2
ALPHA, BETA, L1, L2 = 0.1, 1.0, 0.02, 0.1
PREDICT = 0.5


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of the text's features."""
    h, kind, first, size = H.tokens(text.lower().encode(), H.MIXED, H.ASCII_LOWER)
    m = np.uint64(BUCKETS - 1)
    words = np.unique(np.concatenate((h, H.windows(h, 2))) & m)
    again = np.zeros(len(h), bool)
    again[1:] = h[1:] == h[:-1]
    signs = kind == 2
    shape = np.where(signs, np.uint64(1000) + first.astype(np.uint64) * np.uint64(4) + np.minimum(size, 3).astype(np.uint64), np.uint64(10) + np.minimum(size, 20).astype(np.uint64) // np.uint64(4))
    shape = np.where(again & ~signs, np.uint64(5), shape)
    shape = H.mix(shape * np.uint64(2654435761))
    parts = [np.ones(1, np.uint64)]
    for n in (1, 2):
        g, c = np.unique(H.windows(shape, n), return_counts=True)
        share = np.minimum(np.floor(-np.log2(c / max(1, len(shape)))), 12).astype(np.uint64)
        parts.append(H.mix(g + share + np.uint64(n)))
    total = np.minimum(np.floor(np.log2(len(h) + 1)), 14)
    parts.append(H.mix(np.array([int(total) + 77], np.uint64)))
    forms = np.unique(np.concatenate(parts) & m)
    idx = np.concatenate((words, forms)).astype(np.int64)
    val = np.concatenate((np.full(len(words), 1 / np.sqrt(max(1, len(words)))), np.full(len(forms), 0.3)))
    return idx, val


def train(rows: list[tuple[int, str, str, int]], epochs: int = EPOCHS) -> tuple[np.ndarray | None, float]:
    """(weights, share of label 1); FTRL-proximal with one step for each document in hashed order."""
    y = np.array([r[3] for r in rows])
    if not len(rows) or y.min() == y.max():
        return None, float(y.mean()) if len(rows) else 0.0
    made = [features(r[2]) for r in rows]
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    rng = np.random.default_rng(3)

    def weights(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, -(z[i] - np.sign(z[i]) * L1) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            i, x = made[k]
            w = weights(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y[k]) * x
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            np.add.at(z, i, g - s * w)
            np.add.at(n, i, g * g)
    return weights(np.arange(BUCKETS)).astype(np.float32), float(y.mean())


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    w, share = trained(docs, labels, "quality", sample, train)
    shared = docs.sparkSession.sparkContext.broadcast(w)

    def rate(texts: list[str]) -> np.ndarray:
        if shared.value is None:
            return np.full(len(texts), share)
        out = np.empty(len(texts))
        for k, t in enumerate(texts):
            i, x = features(t)
            out[k] = shared.value[i] @ x
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))

    out = scored(docs.select("doc_id", "text"), rate)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"))
