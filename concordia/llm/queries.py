"""The registered query of each operator, over its whole table."""

from __future__ import annotations

from . import decontam, langid, neardup, packing, quality_clf, quality_rules, secret_scan, sharding, tokenstore, toxicity


def tokenizer(name: str) -> str:
    """Path of a public tokenizer's file; the environment keeps them, the repository doesn't."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def queries() -> dict:
    docs = lambda s, d: _table(s, d, "documents")
    labels = lambda s, d: _table(s, d, "labels")
    return {
        "op1_secret_scans": lambda s, d: secret_scan.digest(docs(s, d)),
        "op2_language_id": lambda s, d: langid.predict(docs(s, d)),
        "op3_token_output": lambda s, d: tokenstore.digest(docs(s, d), tokenizer("word_bpe_49k.json")),
        "op4_quality_rules": lambda s, d: quality_rules.digest(docs(s, d)),
        "op5_toxicity": lambda s, d: toxicity.score(docs(s, d), labels(s, d)),
        "op6_quality_classifier": lambda s, d: quality_clf.score(docs(s, d), labels(s, d)),
        "op7_minhash_near_dedup": lambda s, d: neardup.classes(docs(s, d)),
        "op8_sharding": lambda s, d: sharding.deal(docs(s, d)),
        "op9_best_fit_packing": lambda s, d: packing.pack(docs(s, d), tokenizer("byte_bpe_50k.json")),
        "secret_base_counts": lambda s, d: secret_scan.digest(docs(s, d)).select("doc_id", "n_assign", "n_access", "n_hex"),
        "quality_base_counts": lambda s, d: quality_rules.digest(docs(s, d)).drop("kept", "posterior"),
        "op10_benchmark_decontamination": lambda s, d: decontam.digest(docs(s, d), _table(s, d, "benchmark")),
    }


BLANK = r"[^\x20\x09-\x0D]"
#: Counts of the base patterns: of all greedy matches, those whose measured part is long enough.
SECRETS = r"""SELECT doc_id, len(list_filter(regexp_extract_all(t, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 8)) AS n_assign,
len(list_filter(regexp_extract_all(t, 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 16)) AS n_access, len(list_filter(regexp_extract_all(t, '[0-9a-f]+'), lambda x: length(x) >= 32)) AS n_hex FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"""
RULES = rf"""WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT *, regexp_extract_all(t, '{BLANK}+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{BLANK}')) AS l FROM d),
g AS (SELECT u, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w),
o AS (SELECT u, i FROM (SELECT *, count(*) OVER (PARTITION BY u, g) AS n FROM g) WHERE n > 1), r AS (SELECT u, count(DISTINCT j) AS n FROM (SELECT u, unnest([i, i + 1, i + 2]) AS j FROM o) GROUP BY u),
c AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN r USING (u))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM c"""


def oracle_sql() -> dict[str, str]:
    """Of the parts that SQL can say. Models, tokenizers and packings have none; tests/llm compares them with brute force or held-out rows."""
    return {"secret_base_counts": SECRETS, "quality_base_counts": RULES}
