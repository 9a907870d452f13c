"""Secret scans: base patterns, and windows of high entropy over candidate strings. SQL functions only.

Places are code points, ends exclusive. Results for odd rows: a null or empty text has no span, its digest is that of
the empty string; repeated rows and rows with a null key are each scanned by themselves; an empty table gives an empty
one. Only the key and the text are read, so further columns, whatever their names, change nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: With the least length in the pattern: the greedy matches that reach it are the same, as a later start in a run is shorter.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: Kind, number (the order of kinds at one start), pattern, group that is measured, least length, a cheap test that a text with a match passes.
BASE = (("assign", 0, ASSIGN, 1, 8, r"(?i:passw|secret|token|api_?key)"), ("access", 1, ACCESS, 0, 16, "AKIA"), ("hex", 2, HEX, 0, 32, "[0-9a-f]{32}"))
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
LETTERS = "^(?:[A-Z]?[a-z]+|[A-Z]+)$"
#: Class of a candidate, pattern of the class, bits per character that a window must reach. A window of 20 holds 4.32 bits at most,
#: of digits 3.32. Letters: the 31 long words of sf0.1 reach 3.58, the median of 20 random letters is 3.68; of random digits, 2.97.
CLASSES = (("digits", "^[0-9]+$", 2.8), ("hex", "^[0-9A-Fa-f]+$", 3.0), ("letters", LETTERS, 3.6), ("alnum", "^[A-Za-z0-9]+$", 3.7), ("base64", "", 3.8))
WINDOW = 20
#: Whole candidates of these forms are no secrets: UUIDs and rules of one sign.
ALLOW = (r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^(.)\1*$")
#: Signs that join the parts of a candidate, and a date that leads it: what follows is judged by itself.
JOIN, DATE = "[/_=+-]", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"
#: Plain parts: words, several by capitals too, and what is shorter than a window without a word that marks a placeholder.
PLAIN, MARK = "^[a-z]*(?:[A-Z][a-z]{2,}|[A-Z]{2,}[a-z]{3,})*[A-Z]*$", "(?i:example|placeholder|changeme)"


def _matches(text: Column, kind: int, pattern: str, group: int, least: int, test: str) -> Column:
    """Array of (start, kind, end) of the leftmost non-overlapping matches whose group has the least length.

    Between the pieces that split() leaves stand the matches, so their places are running sums of lengths.
    """
    whole = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.split(text, pattern, -1)
    steps = F.arrays_zip(F.transform(gaps, F.length).alias("gap"), F.transform(whole, F.length).alias("all"), F.transform(part, F.length).alias("part"))
    none = F.array().cast("array<struct<s:int,k:int,e:int>>")
    found = F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + F.coalesce(x["all"], F.lit(0))).alias("at"),
            F.when(x["part"] >= least, F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("s"), F.lit(kind).alias("k"), (a["at"] + x["gap"] + x["all"]).alias("e"))))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    return F.when(text.rlike(test), found).otherwise(none)


def _entropy_spans(text: Column, window: int) -> Column:
    """Array of (start, end) of candidate stretches whose windows all have high entropy.

    Judged are a candidate, without a date that leads it, and each of its parts of a window or more by the part's own class. A
    candidate whose parts are all plain is passed over, but not its parts in letters of one case, which their limit judges.

    Entropy of a window is log2(w) - sum(c * log2(c)) / w over its counts c. As the window moves by one character, two
    counts change by one, and with them the sum: the fold carries the counts of the candidate's own alphabet and the sum.
    """
    cands = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    gaps = F.split(text, CANDIDATE, -1)
    none = F.array().cast("array<struct<at:int,cand:string>>")
    placed = F.aggregate(
        F.arrays_zip(F.transform(gaps, F.length).alias("gap"), cands.alias("cand")),
        F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + F.coalesce(F.length(x["cand"]), F.lit(0))).alias("at"),
            F.when(x["cand"].isNotNull(), F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("at"), x["cand"].alias("cand"))))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )

    def limit(c: Column) -> Column:
        out = F.lit(CLASSES[-1][2])
        for _, pattern, bits in reversed(CLASSES[:-1]):
            out = F.when(c.rlike(pattern), bits).otherwise(out)
        return out

    def units(x: Column) -> Column:
        rest = F.regexp_replace(x["cand"], DATE, "")
        return F.get(F.transform(F.array(F.struct((x["at"] + F.length(x["cand"]) - F.length(rest)).alias("at"), rest.alias("cand"))), with_parts), F.lit(0))

    def with_parts(u: Column) -> Column:
        parts = F.aggregate(
            F.split(u["cand"], JOIN, -1),
            F.struct(u["at"].alias("at"), none.alias("out")),
            lambda a, p: F.struct(
                (a["at"] + F.length(p) + 1).alias("at"),
                F.when((F.length(p) >= window) & (p != u["cand"]), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), p.alias("cand"))))).otherwise(a["out"]).alias("out"),
            ),
            lambda a: a["out"],
        )
        return F.concat(F.array(u), parts)

    def marked(p: Column) -> Column:
        return p.rlike(MARK) & (F.length(F.regexp_replace(p, MARK, "")) < window)

    def suspect(u: Column) -> Column:
        c = u["cand"]
        ok = F.length(c) >= window
        for pattern in ALLOW:
            ok = ok & ~c.rlike(pattern)
        return ok & F.when(c.rlike(LETTERS), ~marked(c)).otherwise(F.exists(F.split(c, JOIN, -1), lambda p: ~(p.rlike(PLAIN) | marked(p))))

    def spans(x: Column) -> Column:
        chars = F.split(x["cand"], "")
        return F.transform(
            F.array(F.struct(x["at"].alias("at"), chars.alias("chars"), F.array_distinct(chars).alias("letters"), limit(x["cand"]).alias("bits"))),
            lambda c: _slide(c, window),
        )[0]

    return _merged(F.flatten(F.transform(F.filter(F.flatten(F.transform(placed, units)), suspect), spans)))


def _merged(spans: Column) -> Column:
    """Spans (s, e) by start, those that overlap as one."""
    none = F.array().cast("array<struct<s:int,e:int>>")
    whole = lambda a: F.struct(a["s"].alias("s"), a["e"].alias("e"))
    return F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(-1).alias("s"), F.lit(-1).alias("e"), none.alias("out")),
        lambda a, x: F.when(x["s"] < a["e"], F.struct(a["s"].alias("s"), F.greatest(a["e"], x["e"]).alias("e"), a["out"].alias("out"))).otherwise(
            F.struct(x["s"].alias("s"), x["e"].alias("e"), F.when(a["e"] >= 0, F.concat(a["out"], F.array(whole(a)))).otherwise(a["out"]).alias("out"))
        ),
        lambda a: F.when(a["e"] >= 0, F.concat(a["out"], F.array(whole(a)))).otherwise(a["out"]),
    )


def _slide(c: Column, w: int) -> Column:
    """Fold over the characters of one candidate; gives (start, end) of merged windows over its limit."""
    def term(n: Column) -> Column:
        return F.when(n > 1, n * F.log2(n)).otherwise(F.lit(0.0))

    none = F.array().cast("array<struct<s:int,e:int>>")
    start = F.struct(
        F.lit(0).alias("i"),
        F.transform(c["letters"], lambda _: F.lit(0)).alias("n"),
        F.lit(0.0).alias("sum"),
        F.lit(-1).alias("open"),
        F.lit(-1).alias("last"),
        none.alias("out"),
    )

    def step(a: Column, ch: Column) -> Column:
        i = a["i"]
        new = F.array_position(c["letters"], ch).cast("int") - 1
        old = F.when(i >= w, F.array_position(c["letters"], F.get(c["chars"], F.greatest(i - w, F.lit(0)))).cast("int") - 1).otherwise(F.lit(-1))
        a_new, a_old = F.get(a["n"], new), F.get(a["n"], F.greatest(old, F.lit(0)))
        change = F.when(new == old, F.lit(0.0)).otherwise(term(a_new + 1) - term(a_new) + F.when(old >= 0, term(a_old - 1) - term(a_old)).otherwise(F.lit(0.0)))
        counts = F.transform(a["n"], lambda n, k: n + (k == new).cast("int") - (k == old).cast("int"))
        total = a["sum"] + change
        high = (i + 1 >= w) & (F.lit(_log2(w)) - total / w >= c["bits"])
        s = i - (w - 1)
        fresh = high & ((a["open"] < 0) | (s > a["last"]))
        shut = fresh & (a["open"] >= 0)
        return F.struct(
            (i + 1).alias("i"),
            counts.alias("n"),
            total.alias("sum"),
            F.when(fresh, s).otherwise(a["open"]).alias("open"),
            F.when(high, i + 1).otherwise(a["last"]).alias("last"),
            F.when(shut, F.concat(a["out"], F.array(F.struct((c["at"] + a["open"]).alias("s"), (c["at"] + a["last"]).alias("e"))))).otherwise(a["out"]).alias("out"),
        )

    done = lambda a: F.when(a["open"] >= 0, F.concat(a["out"], F.array(F.struct((c["at"] + a["open"]).alias("s"), (c["at"] + a["last"]).alias("e"))))).otherwise(a["out"])
    return F.aggregate(c["chars"], start, step, done)


def _log2(w: int) -> float:
    import math

    return math.log2(w)


def scan(docs: DataFrame, text: str = "text", window: int = WINDOW, prefix: str = "_") -> DataFrame:
    """docs with two more columns: {prefix}base and {prefix}all, arrays of (s, k, e) by start, then kind; kind 3 is entropy.

    An entropy span that base spans cover wholly is left to them; one that reaches beyond them is kept, so spans may overlap.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    out = docs.withColumn(f"{prefix}base", F.array_sort(F.concat(*(_matches(t, n, p, g, least, test) for _, n, p, g, least, test in BASE))))
    high = F.when(t.rlike(CANDIDATE), _entropy_spans(t, window)).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
    out = out.withColumn(f"{prefix}high", high)
    reach = lambda h: F.aggregate(F.col(f"{prefix}base"), h["s"], lambda a, b: F.when(b["s"] <= a, F.greatest(a, b["e"])).otherwise(a))
    free = F.filter(F.col(f"{prefix}high"), lambda h: reach(h) < h["e"])
    extra = F.transform(free, lambda h: F.struct(h["s"].alias("s"), F.lit(3).alias("k"), h["e"].alias("e")))
    return out.withColumn(f"{prefix}all", F.array_sort(F.concat(F.col(f"{prefix}base"), extra))).drop(f"{prefix}high")


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(b[0]) for b in BASE), F.lit("entropy"))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """Row of counts and digests for each row of docs(doc_id, text)."""
    found = scan(docs.select("doc_id", "text"))
    n = lambda k: F.size(F.filter("_base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(joined(F.col("_base")), 256).alias("base_sha256"), joined(F.col("_all")).alias("spans"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs, its columns and rows, with each span of its text replaced by mark; overlapping spans become one mark."""
    found = scan(docs, text, prefix="__secret_")
    spans, t = F.col("__secret_all"), F.col(text)
    cut = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(
            x["s"] >= a["at"], F.struct(x["e"].alias("at"), F.concat(a["out"], F.substring(t, a["at"] + 1, x["s"] - a["at"]), F.lit(mark)).alias("out"))
        ).otherwise(F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out"))),
        lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))),
    )
    return found.withColumn(text, F.when(F.size(spans) > 0, cut).otherwise(t)).drop("__secret_base", "__secret_all")
