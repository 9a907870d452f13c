"""Registered queries over whole tables; plans/oracle.py has the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concordia.functions import similarity
from concordia.functions import text as T
from concordia.operators import consensus, sequence, witnesses
from concordia.sources import extract, files, sinks

from . import product
from .oracle import oracle_sql  # noqa: F401  the catalog's other half

PHRASE, LONG_PHRASE, NEAR_PHRASE = "of the", "the and to", "the tionly"
#: A reader that can't run any more, and those that are asked.
DEAD, ACTIVE = "view", ("view", "click", "purchase")


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark, d) -> DataFrame:
    return witnesses.spread(_t(spark, d, "documents"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three readings, line majority, reassembly, phrase filter."""
    voted = witnesses.reassemble(witnesses.decide(witnesses.synthesize(_docs(spark, sf_dir))))
    voted = voted.withColumn("words", T.phrase_words(F.col("text")))
    return voted.where(T.has_phrase(F.col("words"), PHRASE)).select("doc_id", "n_lines", "agreed", F.md5("text").alias("digest"))


def _boxes(spark, d):
    """Every word of every text as a box, eight to a row."""
    w = _docs(spark, d).select("doc_id", F.posexplode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ", -1)).alias("seq", "word")).where("word <> ''")
    r = F.floor(F.col("seq") / 8).cast("int")
    return w.select(
        F.col("doc_id").alias("page"), "seq", "word", (r * 40 + F.pmod(F.col("seq") * 7, F.lit(5))).alias("top"), (F.pmod("seq", F.lit(8)) * 100).alias("left"),
        (F.lit(40) + F.pmod(F.col("seq") * 13, F.lit(61))).alias("width"), (F.lit(18) + F.pmod("seq", F.lit(5))).alias("height"), F.pmod("seq", F.lit(101)).alias("conf"),
    )


def _tables(spark, d):
    """The boxes as a reader prints them, some with a number that isn't."""
    cells = ["5", "1", "1", "1", "1", F.col("seq").cast("string"), F.when(F.col("seq") % 50 == 49, "x").otherwise(F.col("left").cast("string")), *(F.col(c).cast("string") for c in ("top", "width", "height", "conf")), F.col("word")]
    line = F.concat_ws("\t", *(F.lit(c) if isinstance(c, str) else c for c in cells))
    rows = F.sort_array(F.collect_list(F.struct("seq", line.alias("line"))))
    return _boxes(spark, d).groupBy("page").agg(F.concat(F.lit("level\tpage\n"), F.array_join(F.transform(rows, lambda r: r["line"]), "\n")).alias("tsv"))


def _polls(spark, d):
    e = _t(spark, d, "events")
    by_user = Window.partitionBy("user_id").orderBy("ts", "event_id")
    snap = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.col("event_type"))
    return e.select(F.col("user_id").alias("key"), F.row_number().over(by_user).alias("seq"), snap.alias("snap"), F.col("event_type").alias("witness"))


def _timed(polls: DataFrame) -> DataFrame:
    """Polls half a minute apart; the first ones of every third key are blank."""
    blank = (F.col("key") % 3 == 0) & (F.col("seq") <= 1 + F.col("key") % 5)
    return polls.withColumn("at", (F.col("seq") - 1) * 15).withColumn("snap", F.when(blank, "").otherwise(F.col("snap")))


def _texts(spark, d):
    doc = _docs(spark, d).select("doc_id", T.letters(F.col("text")).alias("q"))
    one = [F.struct(F.lit(w).alias("witness"), F.lit(i).alias("rank"), F.floor(F.pmod(F.col("doc_id") * (i + 3), F.lit(10)) * F.col("q") / 10).alias("quality")) for i, w in enumerate(witnesses.WITNESSES)]
    return doc.select("doc_id", F.explode(F.array(*one)).alias("x")).select("doc_id", "x.*")


def _readings(spark, d):
    """Three readings of each whole document: lines voted apart by md5 errors, put together again."""
    rows = witnesses.synthesize(_t(spark, d, "documents"))
    text = lambda w: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("row_no", w))), lambda r: F.coalesce(r[w], F.lit(""))), "\n").alias(w)
    return consensus.spread(rows).groupBy("doc_id").agg(*(text(w) for w in witnesses.WITNESSES))


def _grid(spark, d):
    """Pages of lines: each order's parts as places, with page sizes from the order."""
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), F.col("l_partkey").cast("int").alias("y"))
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("page"), (F.col("o_orderkey") % 4000 + 500).cast("int").alias("width"), (F.col("o_custkey") % 3000 + 1000).cast("int").alias("height"))
    return lines, o


def _searched(spark, d):
    """The phrase filter with a second chance by a reader that quotes the phrase's last word where it stands."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    return product.searched(witnesses.spread(docs), "license terms", lambda chunk, phrase: "license" if "license" in chunk else "")


def _phrase(spark, d, phrase):
    return _docs(spark, d).select("doc_id", T.phrase_words(F.col("text")).alias("words")).where(T.has_phrase(F.col("words"), phrase)).select("doc_id")


def _lexicon(spark, d):
    return _t(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}[\p{L}\p{N}_'-]{2,}"), F.lit(0))).alias("word")).distinct()


def queries() -> dict:
    digest = lambda c, name="digest": F.md5(c).alias(name)
    lines = lambda s, d: _docs(s, d).select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("pos", "line"))
    return {
        "clean_text": lambda s, d: _docs(s, d).select("doc_id", T.clean_text(F.col("text")).alias("clean")),
        "text_confidence": lambda s, d: _docs(s, d).select("doc_id", T.text_confidence(F.col("text")).alias("confidence")),
        "training_gate": lambda s, d: _docs(s, d).where(T.good_training_text(F.col("text"))).select("doc_id", T.letters(F.col("text")).alias("letters")),
        "training_pairs": lambda s, d: sinks.training_pairs(_docs(s, d).select(F.concat(F.col("source"), F.lit(" / "), F.col("doc_id").cast("string"), F.repeat(F.lit("x"), F.lit(60))).alias("doc_id"), F.lit(None).cast("binary").alias("png"), "text")).select("label", digest("text")),
        "enough_letters": lambda s, d: _docs(s, d).where(T.letters(F.col("text")) >= product.MIN_LETTERS).select("doc_id"),
        "noise_strip": lambda s, d: _docs(s, d).select("doc_id", digest(T.strip_garbage(F.col("text")))),
        "noise_strip_pages": lambda s, d: _t(s, d, "pages").select("page_id", digest(T.strip_garbage(F.col("html")))),
        "normalized": lambda s, d: _t(s, d, "conversations").select("conv_id", "turn", digest(T.normalize(F.concat(F.lit(" \r\n"), F.replace("text", F.lit("\n"), F.lit("\r\n")), F.lit("\t"))))),
        "fold_keys": lambda s, d: lines(s, d).select("doc_id", digest(T.fold(F.col("line")), "fold")),
        "look_alikes": lambda s, d: witnesses.synthesize(_docs(s, d)).select("doc_id", "row_no", digest(T.tidy(F.concat_ws(" ", "tesseract", "truth")), "tidy"), digest(T.fold(F.concat_ws(" ", "tesseract", "truth")), "fold")),
        "squash_keys": lambda s, d: _docs(s, d).select("doc_id", digest(T.squash(F.col("text")), "squash"), digest(T.token_key(F.col("text")), "key")),
        "tokens": lambda s, d: _docs(s, d).select("doc_id", T.tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("n"), digest(F.array_join("t", "|"))),
        "distinct_lines": lambda s, d: _docs(s, d).select("doc_id", F.array_distinct(F.split("text", "\n", -1)).alias("t")).select("doc_id", F.size("t").alias("n"), digest(F.array_join("t", "\n"))),
        "known_worth": lambda s, d: T.known_worth(_docs(s, d), _lexicon(s, d)),
        "line_majority": lambda s, d: witnesses.decide(witnesses.synthesize(_docs(s, d))),
        "agreement_report": lambda s, d: witnesses.decide(witnesses.synthesize(_docs(s, d))).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if("decided").alias("agreed"), F.count_if(~F.col("decided")).alias("disputed")),
        "error_rates": lambda s, d: _error_rates_of(_docs(s, d)),
        "base_witness": lambda s, d: witnesses.base_witness(_texts(s, d)),
        "voted_phrase": flagship,
        "merge": lambda s, d: consensus.merge(_readings(s, d)).select("doc_id", "base", digest("text"), *consensus.COUNTS),
        "text_vote": lambda s, d: _readings(s, d).select("doc_id", digest(consensus.text_vote_udf(F.array(*witnesses.WITNESSES)))),
        "quorum_report": lambda s, d: _reports(_readings(s, d)),
        "word_ratio": lambda s, d: _ratios(s, d),
        "phrase_exact_gap": lambda s, d: _phrase(s, d, PHRASE),
        "phrase_three_words": lambda s, d: _phrase(s, d, LONG_PHRASE),
        "phrase_fuzzy": lambda s, d: similarity.fuzzy_phrase(_docs(s, d), NEAR_PHRASE),
        "second_chance": lambda s, d: _searched(s, d).select("doc_id", "read", "matched", "how"),
        "search_summary": lambda s, d: product.summary(_searched(s, d)),
        "phrase_windows": lambda s, d: sequence.windows(_docs(s, d)).select("doc_id", "start", digest("chunk")),
        "layout_lines": lambda s, d: sequence.layout(_boxes(s, d)),
        "layout_confident": lambda s, d: sequence.layout(_boxes(s, d), 40),
        "layout_tables": lambda s, d: extract.layout_pages(_tables(s, d)).select("page", digest("text")),
        "stability": lambda s, d: sequence.stable(_polls(s, d)),
        "stability_scan": lambda s, d: sequence.stable(_polls(s, d), 3),
        "stability_outcome": lambda s, d: sequence.outcome(_timed(_polls(s, d))),
        "rendezvous": lambda s, d: sequence.rendezvous(_polls(s, d), 5),
        "rendezvous_dead": lambda s, d: sequence.gathered(_polls(s, d).where(F.col("witness") != DEAD).withColumn("text", F.concat_ws("-", "witness", "seq")), ACTIVE, (DEAD,)),
        "grid_regularity": lambda s, d: sequence.regularity(_grid(s, d)[0]),
        "line_height": lambda s, d: sequence.line_height(*_grid(s, d)),
        "header_end": lambda s, d: sequence.header_end(*_grid(s, d)),
        "strips": lambda s, d: sequence.strips(*_grid(s, d), rows=4),
        "safe_dpi": lambda s, d: _t(s, d, "customer").select("c_custkey", files.safe_dpi(F.col("c_acctbal")).alias("dpi")),
        "preset_argmax": lambda s, d: sequence.best_preset(_t(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("preset"), F.col("l_quantity").alias("score"))),
        "run_summary": lambda s, d: _docs(s, d).groupBy("source").agg(F.count("*").alias("total"), F.count_if(T.letters(F.col("text")) >= product.MIN_LETTERS).alias("read"), F.count_if(T.good_training_text(F.col("text"))).alias("training")),
        "short_circuit": lambda s, d: product.unread(_t(s, d, "documents").select("doc_id"), _t(s, d, "labels").where("quality = 1").select("doc_id").join(_t(s, d, "documents").select("doc_id", "text"), "doc_id")),
    }


def _error_rates_of(docs):
    rows = witnesses.synthesize(docs)
    voted = witnesses.decide(rows, "truth", *witnesses.WITNESSES).withColumnRenamed("line", "vote")
    return witnesses.error_rates(voted, *witnesses.WITNESSES, "vote")


def _reports(docs):
    return consensus.report_json(consensus.merge(docs), docs)


def _ratios(spark, d):
    """Words of the benchmark against three stated ones, in this order."""
    words = _t(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,12}"), F.lit(0))).alias("word")).distinct()
    pairs = words.select("word", F.explode(F.array(*map(F.lit, ("tide", "thereth", "nation")))).alias("token"))
    return pairs.select("word", "token", F.round(similarity.ratio_udf("word", "token"), 9).alias("ratio"))
