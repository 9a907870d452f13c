"""Quality rules as weak supervision: rules vote or abstain, EM estimates how far to trust each, a posterior decides.

SQL functions only. Odd rows: a null or empty text has no words, so it fails the base rules and isn't kept; repeated
rows are each judged; very long texts are counted whole; a posterior at the limit keeps; an empty table gives an empty one. Only the
key and the text are read; columns of docs that are named like a result give way to it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
EM_ROUNDS = 30
#: Columns of the results.
RESULTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_sign_runs", "n_lines", "n_kinds", "base_failed", "posterior", "kept")
#: Share of good documents before any is seen; first values and least ones of P(+ | good) and P(- | bad), for a bad document
#: breaks few rules; the most of either. They keep the classes from trading places.
PRIOR, FIRST, LOW, HIGH = 0.8, (0.98, 0.3), (0.55, 0.05), 0.995


def _rules() -> dict[str, tuple[Column, Column]]:
    """Rule to (votes good, votes bad); neither: it abstains."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    mean, signs, runs = F.col("word_chars") / words, F.col("n_symbols") / words, F.col("n_sign_runs") / words
    lines = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))
    repeat, kinds = F.col("n_repeat_words") / words, F.col("n_kinds") / words
    return {
        "length": (F.col("n_words") >= 80, F.col("n_words") < MIN_WORDS),
        "word_length": ((mean >= 3) & (mean <= 9), (mean < 2.5) | (mean > 12)),
        "signs": (signs <= 0.03, signs > 0.15),
        "sign_runs": (runs <= 0.03, runs > 0.15),
        "lines": (lines <= 0.15, lines > 0.4),
        "repeats": (repeat <= 0.1, repeat > 0.4),
        "kinds": ((kinds >= 0.3) | ((F.col("n_words") > 2000) & (kinds >= 0.1)), kinds < 0.08),
    }


def words(text: Column) -> Column:
    """Runs of anything but white space. Other white space turns into blanks, so that split() takes its path without a regex."""
    for sign in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(sign), F.lit(" "))
    return F.array_remove(F.split(text, " ", -1), "")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts that the rules read, each over the whole text.

    n_repeat_words: three-word windows are compared by 64-bit hash, built from two overlapping pairs. Sorted hashes show which
    return; their places come from a look at each window if they are few, else from a sort of (hash, place).
    """
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in RESULTS)) if set(docs.columns) - set(RESULTS) else F.struct(F.lit(0))
    t = F.col("_t")
    df = docs.select(own.alias("_row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_t")).withColumn("_w", words(t)).withColumn("_lines", F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    n = F.size("_w")
    two = F.zip_with(F.col("_w"), F.slice("_w", 2, n), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_two", two)
    three = F.zip_with(F.col("_two"), F.slice("_two", 2, n), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("_h", F.slice(three, 1, F.greatest(n - 2, F.lit(0))))
    df = df.withColumn("_sorted", F.sort_array("_h"))
    again = F.zip_with(F.col("_sorted"), F.slice("_sorted", 2, n), lambda a, b: F.when(a == b, a))
    df = df.withColumn("_again", F.array_distinct(F.array_compact(again)))
    few = F.array_compact(F.transform("_h", lambda h, i: F.when(F.array_contains(F.col("_again"), h), i)))
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("_few", F.when((F.size("_again") > 0) & (F.size("_again") <= 16), few)).withColumn("_pairs", F.when(F.size("_again") > 16, pairs))
    s = F.col("_pairs")
    near = F.filter(s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False)))
    spots = F.coalesce(F.col("_few"), F.transform(near, lambda x: x["i"]), F.array().cast("array<int>"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(spots, lambda i: F.array(i, i + 1, i + 2)))))
    signs = sum((F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) for c in "#*$%&|<>"), F.lit(0))
    df = df.withColumn("_signs", signs)
    return df.select(
        "_row.*",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.col("_signs").cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.when(F.col("_signs") > 0, F.regexp_count(t, F.lit(r"[#*$%&|<>]+"))).otherwise(F.lit(0)).cast("long").alias("n_sign_runs"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(F.array_distinct("_w")).cast("long").alias("n_kinds"),
    )


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = EM_ROUNDS) -> tuple[float, list[tuple[float, float]]]:
    """EM over (votes, count) pairs. Returns the share of good documents and for each rule P(+ | good), P(- | bad), given that it votes."""
    if not patterns:
        return PRIOR, []
    prior, acc = PRIOR, [FIRST] * len(patterns[0][0])
    for _ in range(rounds):
        mass, hit, seen, total = 0.0, [[0.0, 0.0] for _ in acc], [[0.0, 0.0] for _ in acc], 0
        for votes, n in patterns:
            good = 1 / (1 + math.exp(-max(-50.0, min(50.0, log_odds(votes, prior, acc)))))
            mass, total = mass + n * good, total + n
            for r, v in enumerate(votes):
                if v:
                    for y, p in ((0, good), (1, 1 - good)):
                        seen[r][y] += n * p
                        hit[r][y] += n * p * (v == (1, -1)[y])
        prior = min(0.95, max(0.05, mass / total))
        acc = [tuple(min(HIGH, max(LOW[y], (hit[r][y] + 8 * FIRST[y]) / (seen[r][y] + 8))) for y in (0, 1)) for r in range(len(acc))]
    return prior, acc


def log_odds(votes, prior: float, acc) -> float:
    out = math.log(prior / (1 - prior))
    for v, (g, b) in zip(votes, acc):
        out += math.log(g / (1 - b)) if v > 0 else math.log((1 - g) / b) if v < 0 else 0.0
    return out


def judge(docs: DataFrame, text: str = "text", least: float = 0.5, with_features: DataFrame | None = None) -> DataFrame:
    """docs(key columns and text) without the text, with the counts, base_failed, the posterior that a document is good, and kept.

    The features are written once and read twice. What comes to the driver is a count for each pattern of votes: with 7 rules
    of 3 outcomes 2,187 rows at most, whatever the input.
    """
    ws = Workspace(docs.sparkSession, "rules")
    feats = ws.cut(features(docs, text).drop(text), "features")
    rules = _rules()
    vote = [F.when(bad, -1).when(good, 1).otherwise(0).alias(f"_v_{name}") for name, (good, bad) in rules.items()]
    names = [f"_v_{name}" for name in rules]
    voted = feats.select("*", *vote)
    patterns = [(tuple(r[c] for c in names), r["n"]) for r in voted.groupBy(*names).agg(F.count("*").alias("n")).collect()]
    prior, acc = fit(sorted(patterns))
    odds = F.lit(math.log(prior / (1 - prior)))
    for c, (g, b) in zip(names, acc):
        odds = odds + F.when(F.col(c) > 0, math.log(g / (1 - b))).when(F.col(c) < 0, math.log((1 - g) / b)).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = voted.withColumn("base_failed", failed).withColumn("posterior", 1 / (1 + F.exp(-odds)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least)).drop(*names)


def digest(docs: DataFrame) -> DataFrame:
    return judge(docs.select("doc_id", "text")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
