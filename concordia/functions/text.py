"""Scalar text functions as Column expressions; all but those of look-alikes (batch.py) stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Latin letters and the Cyrillic letters that look like them, by place.
LATIN = "ABCEHIKMOPTXYaceiopxy"
CYRILLIC = "АВСЕНІКМОРТХУасеіорху"
# Apostrophes, dashes and the no-break space, and what they become.
SIGNS, PLAIN = "’ʼ`‘´—– ", "'''''-- "
SPACE = r"[\s\x1c-\x1f]"
CYR = r"[А-Яа-яЁёІіЇїЄєҐґ]"
TRIM = rf"(?U)^{SPACE}+|{SPACE}+$"


def clean_text(t: Column) -> Column:
    t = F.translate(F.regexp_replace(t, "[\f\0]", ""), "\u00a0", " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(t, " {2,}", " "), "\n{3,}", "\n\n"), TRIM, "")


def count(t: Column, not_wanted: str) -> Column:
    return F.length(F.regexp_replace(t, not_wanted, ""))


def text_confidence(t: Column) -> Column:
    """Share of letters, digits and common punctuation among what isn't white space; 0 for blank text."""
    n = count(t, rf"(?U){SPACE}")
    good = count(t, r"[^\p{L}\p{Nd}²³¹.,;:!?()\-/\\]")
    return F.when(n > 0, good / n).otherwise(F.lit(0.0))


def letters(t: Column) -> Column:
    return count(t, r"[^\p{L}]")


def good_training_text(t: Column) -> Column:
    signs = count(t, r"[^@#$%^&*_=+<>\[\]{}~`]")
    return (F.length(F.regexp_replace(t, TRIM, "")) >= 100) & (text_confidence(t) >= 0.82) & (signs <= 0.03 * F.length(t))


def strip_garbage(t: Column) -> Column:
    """Runs of one sign shrink to one; words whose core has no letter or digit go, line by line."""
    t = F.regexp_replace(t, r"(?U)([^\p{L}\p{N}_\s\x1c-\x1f])\1{2,}", "$1")

    def keep(w: Column) -> Column:
        core = F.btrim(w, F.lit(".,;:!?()-–—/\\"))
        return (w != "") & ((core == "") | core.rlike(r"[\p{L}\p{N}]"))

    return F.array_join(F.transform(F.split(t, "\n", -1), lambda line: F.array_join(F.filter(F.split(line, " ", -1), keep), " ")), "\n")


def tidy(t: Column) -> Column:
    """Signs in their plain form, single blanks, none around punctuation, and look-alikes as Cyrillic in Cyrillic words."""
    from . import batch

    return batch.tidy_udf(t)


def fold(t: Column) -> Column:
    """Key under which readings of a line are equal."""
    from . import batch

    return batch.fold_udf(t)


def lines(t: Column) -> Column:
    from . import batch

    return batch.lines_udf(t)


def phrase_words(t: Column) -> Column:
    """Upper-case words of a text, with separators , . : ; and the no-break space as blanks."""
    return F.array_remove(F.split(F.translate(F.upper(t), "\r\n\t,.:; ", "        "), " ", -1), "")


def has_phrase(words: Column, phrase: str, max_gap: int = 2) -> Column:
    """Whether the phrase's words follow each other, each the first equal one within max_gap places of the one before.

    words is bound to a name of the inner function, else the optimizer would repeat its expression for every place.
    """
    wanted = phrase.upper().split()
    if not wanted:
        return F.lit(True)

    def follows(w: Column) -> Column:
        starts = F.array_compact(F.transform(w, lambda x, i: F.when(x == wanted[0], i)))
        for t in wanted[1:]:
            starts = F.array_compact(F.transform(starts, lambda p: F.array_min(F.filter(F.sequence(p + 1, p + max_gap), lambda j: (j < F.size(w)) & (F.get(w, j) == t)))))
        return F.size(starts) > 0

    return F.exists(F.array(words), follows)


def token_key(t: Column) -> Column:
    """Look-alikes as one, lower case; white space stays."""
    return F.lower(F.translate(t, LATIN, CYRILLIC))


def squash(t: Column) -> Column:
    """A string's key without white space, and without the changes of tidy."""
    return F.regexp_replace(token_key(t), rf"(?U){SPACE}+", "")


def normalize(t: Column) -> Column:
    """Line feeds alone end lines, and no white space is at the ends."""
    return F.regexp_replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), TRIM, "")


def tokens(t: Column) -> Column:
    """Numbers with inner signs, words, and single punctuation marks, in order."""
    return F.regexp_extract_all(t, F.lit(r"\p{Nd}+(?:[.,:/*x×-]\p{Nd}+)*|[\p{L}\p{N}_][\p{L}\p{N}_'-]*|(?U:[^\p{L}\p{N}_\s\x1c-\x1f])"), F.lit(0))


def known_worth(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, worth): known words and numbers of the lines of which three fifths or more are known; lexicon has word, in lower case.

    Words are looked up once for each distinct one. A word is known if its parts between hyphens are; rows that repeat a key are
    summed; a null or empty text has no words, so it is worth 0.
    """
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    found = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n", -1)).alias("line", "t"))
    words = found.select("doc_id", "row", "line", F.explode(F.regexp_extract_all("t", F.lit(r"\p{L}[\p{L}\p{N}_'-]{2,}|\p{Nd}+"), F.lit(0))).alias("word"))
    number = F.col("word").rlike(r"^\p{Nd}+$")
    parts = words.where(~number).select("word").distinct().select("word", F.explode(F.array_remove(F.split(F.lower("word"), "-", -1), "")).alias("part"))
    known = parts.join(lexicon.select(F.col("word").alias("part")).distinct().withColumn("there", F.lit(1)), "part", "left").groupBy("word").agg(F.min(F.coalesce("there", F.lit(0))).alias("known"))
    rated = words.join(known, "word", "left").withColumn("good", F.when(number, 1).otherwise(F.coalesce("known", F.lit(0))))
    lines = rated.groupBy("doc_id", "row", "line").agg(F.sum("good").alias("good"), F.count("*").alias("n")).where("5 * good >= 3 * n")
    worth = lines.groupBy("doc_id").agg(F.sum("good").alias("worth"))
    return docs.select("doc_id").distinct().join(worth, "doc_id", "left").select("doc_id", F.coalesce("worth", F.lit(0)).cast("long").alias("worth"))
