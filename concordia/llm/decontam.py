"""Benchmark decontamination by templates. SQL functions only.

Numbers (also behind a sign), names (words that begin with a capital of any script) and units become typed placeholders;
windows of template tokens are joined by hash; a match counts if the fillers of its slots map to those of the item one to one,
as most places of the whole alignment do. So a question with other numbers or names is found, and chance likeness of templates is
not. Beside them, windows of the words themselves, without regard to case, are joined: a window is held if either form matches. So
passages in capitals, and items that are mostly numbers or names, whose windows have too many slots, are found too.

An item counts as held by a share of its windows, COVER, or by RUN words of it in a row, word for word, whatever the share.

Odd rows: null and empty texts hold no window and are kept, and so are rows with a null key, which no result could name;
rows that repeat a key are judged together; benchmark items that are null or have fewer than MIN_ITEM tokens match nothing;
several items under one key are one; an empty benchmark flags nothing; an empty table gives an empty one; very long texts are
searched whole. Ties: of pairings that as many places bear out, equal words go first, then the earlier place. Only key and text are
read, whatever other columns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, packed_rows, select_ids

WINDOW, MIN_ITEM = 8, 5
SIGNS = ".,;:!?\"'()[]{}"
#: Share of an item's windows that one document must hold, and the largest share of slots in a template window.
COVER, MAX_SLOTS = 0.5, 0.5
#: Words in a row, word for word, that make a match by themselves.
RUN = 13
#: Benchmark windows with their tokens and fillers are broadcast up to this size; more are joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: Signs before a number, as code points.
LEADS = tuple(map(ord, "$€£¥+-−±~=<>#*"))
UNITS = ("kg", "g", "mg", "km", "m", "cm", "mm", "mi", "miles", "l", "ml", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "years", "usd", "eur", "dollars", "euros", "cents", "percent", "mph", "kmh")


def _words(text: Column) -> Column:
    """Words without the signs at their ends. Other white space turns into blanks, so that split() takes its path without a regex."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    for sign in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(sign), F.lit(" "))
    return F.array_remove(F.transform(F.split(text, " ", -1), lambda w: F.btrim(w, F.lit(SIGNS))), "")


def _template(words: Column) -> Column:
    """Template token of each word; a placeholder is a sign that no word consists of."""
    def one(w: Column) -> Column:
        first = F.ascii(w)
        head = F.substring(w, 1, 1)
        named = first.between(65, 90) | ((first >= 192) & (F.lower(head) != head))
        counted = first.between(48, 57) | (first.isin(*LEADS) & F.ascii(F.substring(w, 2, 1)).between(48, 57))
        return F.when(first.between(97, 122), F.when(w.isin(*UNITS), "~").otherwise(w)).when(counted, "#").when(named, "@").otherwise(w)

    return F.transform(words, one)


def _literal(words: Column) -> Column:
    """Words in lower case, the German sharp s as its capitals would be written."""
    return F.transform(words, lambda w: F.replace(F.lower(w), F.lit("ß"), F.lit("ss")))


def _with_windows(df: DataFrame, n: int, tokens: str, out: str) -> DataFrame:
    """df with out: the hash of each window of n tokens, put together from windows of 1, 2, 4 ... tokens."""
    size = F.size(tokens)
    df = df.withColumn("_p0", F.transform(tokens, lambda t: F.xxhash64(t)))
    span, at, names = 1, 0, ["_p0"]
    while 2 * span <= n:
        df = df.withColumn(f"_p{at + 1}", F.zip_with(F.col(f"_p{at}"), F.slice(f"_p{at}", span + 1, size), lambda a, b: F.xxhash64(a, b)))
        span, at = 2 * span, at + 1
        names.append(f"_p{at}")
    done = span
    df = df.withColumn(out, F.col(f"_p{at}"))
    for k in range(at - 1, -1, -1):
        if done + (1 << k) <= n:
            df = df.withColumn(out, F.zip_with(F.col(out), F.slice(f"_p{k}", done + 1, size), lambda a, b: F.xxhash64(a, b)))
            done += 1 << k
    return df.withColumn(out, F.slice(out, 1, F.greatest(size - (n - 1), F.lit(0)))).drop(*names)


def _located(df: DataFrame, key: str, text: str, n: int, ws: Workspace | None = None, name: str = "") -> DataFrame:
    """(key, h) of all windows of both forms, or with ws (key, lit, pos, h, t, fill): their tokens and, unless lit, the fillers of
    their slots, but of no template window with too many slots."""
    df = df.select(key, _words(F.col(text)).alias("_w")).withColumn("_t", _template(F.col("_w"))).withColumn("_l", _literal(F.col("_w")))
    df = _with_windows(_with_windows(df, n, "_t", "_h"), n, "_l", "_g")
    if ws is None:
        # outer: for explode() the optimizer adds a filter on the array and pushes it down, with all that makes the array copied in
        return df.select(key, F.explode_outer(F.concat("_h", "_g")).alias("h"))
    df = ws.cut(df, name)  # else the optimizer would put the split of the text into the function over its windows
    w, t = F.col("_w"), F.col("_t")

    def fillers(i: Column) -> Column:
        pairs = F.zip_with(F.slice(t, i + 1, n), F.slice(w, i + 1, n), lambda a, b: F.struct(a.alias("t"), b.alias("w")))
        return F.transform(F.filter(pairs, lambda p: p["t"].isin("#", "~", "@")), lambda p: F.lower(p["w"]))

    def row(lit: bool, tokens: str, fill) -> Column:
        return lambda x, i: F.struct(F.lit(lit).alias("lit"), i.alias("pos"), x.alias("h"), F.slice(tokens, i + 1, n).alias("t"), fill(i).alias("fill"))

    none = F.array().cast("array<string>")
    rows = F.concat(F.transform("_h", row(False, "_t", fillers)), F.transform("_g", row(True, "_l", lambda i: none)))
    return df.select(key, F.explode(rows).alias("x")).select(key, "x.*").where(F.size("fill") <= F.lit(int(MAX_SLOTS * n)))


def _placed(fill: Column, tokens: Column, pos: Column) -> Column:
    """Fillers (p, w) with their places in the item; pos is the place of the window."""
    slots = F.filter(F.transform(tokens, lambda x, i: F.when(x.isin("#", "~", "@"), pos + i)), lambda p: p.isNotNull())
    return F.zip_with(slots, fill, lambda p, w: F.struct(p.alias("p"), w.alias("w")))


def _one_to_one(pairs: Column) -> Column:
    """Whether the distinct pairs (a, b) are a bijection."""
    left = F.size(F.array_distinct(F.transform(pairs, lambda p: p["a"])))
    right = F.size(F.array_distinct(F.transform(pairs, lambda p: p["b"])))
    return (left == F.size(pairs)) & (right == F.size(pairs))


def _agreeing(windows: Column) -> Column:
    """Places of the windows (at, pairs) of one alignment that hold to one mapping of the item's fillers to the document's.

    pairs has (p, a, b): at place p of the item stands a, in the document b. The mapping takes the pairs (a, b) by the number
    of their places, equal words first among as many, then the earlier, and leaves out what isn't one to one with those taken.
    """
    kind = "array<struct<n:int,other:boolean,p:int,a:string,b:string>>"

    def mapping(places: Column) -> Column:
        def vote(d: Column) -> Column:
            at = F.transform(F.filter(places, lambda x: (x["a"] == d["a"]) & (x["b"] == d["b"])), lambda x: x["p"])
            return F.struct((-F.size(at)).alias("n"), (d["a"] != d["b"]).alias("other"), F.array_min(at).alias("p"), d["a"].alias("a"), d["b"].alias("b"))

        votes = F.array_sort(F.transform(F.array_distinct(F.transform(places, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b")))), vote))
        return F.aggregate(votes, F.array().cast(kind), lambda m, v: F.when(F.exists(m, lambda x: (x["a"] == v["a"]) | (x["b"] == v["b"])), m).otherwise(F.concat(m, F.array(v))))

    def held(w: Column, m: Column) -> Column:
        return F.transform(F.filter(w, lambda x: F.forall(x["pairs"], lambda q: F.exists(m, lambda y: (y["a"] == q["a"]) & (y["b"] == q["b"])))), lambda x: x["at"])

    def judged(w: Column) -> Column:  # each array is bound to a name, else it would be made again for every element
        places = F.array_distinct(F.flatten(F.transform(w, lambda x: x["pairs"])))
        return F.get(F.transform(F.array(places), lambda p: F.get(F.transform(F.array(mapping(p)), lambda m: held(w, m)), F.lit(0))), F.lit(0))

    return F.get(F.transform(F.array(windows), judged), F.lit(0))


def _longest(places: Column) -> Column:
    """The longest run of consecutive numbers among distinct ones."""
    start = F.struct(F.lit(-2).alias("at"), F.lit(0).alias("n"), F.lit(0).alias("best"))

    def step(a: Column, p: Column) -> Column:
        n = F.when(p == a["at"] + 1, a["n"] + 1).otherwise(F.lit(1))
        return F.struct(p.alias("at"), n.alias("n"), F.greatest(a["best"], n).alias("best"))

    return F.aggregate(F.array_sort(places), start, step, lambda a: a["best"])


def matches(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, cover: float = COVER, run: int = RUN) -> DataFrame:
    """(key, item, n_windows, share, run): the items of which a document holds the share cover of windows or more, or run words in a row.

    The share is taken of all windows, and of those that have a template too; the larger one counts. For where names and
    numbers are others, a window with too many slots can't be held.

    First pass: every window hash of every document against those of the benchmark. Second pass: fillers, for the documents
    that have a hash in common only.
    """
    ws = Workspace(docs.sparkSession, "decontam")
    docs = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.col("_key").isNotNull())
    size = F.size(_words(F.col(item_text)))
    items = benchmark.where(F.col(item).isNotNull()).select(F.col(item).alias("_item"), F.col(item_text).alias("_text"), F.least(F.lit(window), size).alias("_n")).where(F.col("_n") >= MIN_ITEM)
    found = None
    for (n,) in sorted(items.select("_n").distinct().collect()):  # at most window - MIN_ITEM + 1 widths, most often one
        own = ws.cut(_located(items.where(F.col("_n") == n), "_item", "_text", n, ws, f"bench{n}"), f"items{n}")
        hashes = own.select("h").distinct()
        weight = F.lit(120) + F.length(F.array_join("t", "")) + F.length(F.array_join("fill", "")) + 24 * (F.size("t") + F.size("fill"))
        few = (own.agg(F.sum(weight)).first()[0] or 0) <= BROADCAST_BYTES
        near = _located(docs, "_key", "_text", n).join(F.broadcast(hashes) if few else hashes, "h", "left_semi")
        ids = ws.cut(near.select("_key").distinct(), f"ids{n}")
        close = _located(select_ids(docs, ids, "left_semi", "_key"), "_key", "_text", n, ws, f"close{n}")
        ours = own.select("_item", "lit", "h", F.col("t").alias("_t"), F.col("pos").alias("_pos"), _placed(F.col("fill"), F.col("t"), F.col("pos")).alias("_fill"))
        pairs = close.join(F.broadcast(ours) if few else ours, ["lit", "h"]).where(F.col("t") == F.col("_t"))
        pairs = pairs.select("_key", "_item", "lit", "_pos", (F.col("pos") - F.col("_pos")).alias("_shift"), F.zip_with("_fill", "fill", lambda a, b: F.struct(a["p"].alias("p"), a["w"].alias("a"), b.alias("b"))).alias("_pairs"))
        pairs = pairs.where(_one_to_one(F.array_distinct(F.transform("_pairs", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))))))
        lines = pairs.groupBy("_key", "_item", "_shift").agg(
            F.collect_set(F.when(F.col("lit"), F.col("_pos"))).alias("_same"), F.collect_set(F.when(~F.col("lit"), F.struct(F.col("_pos").alias("at"), F.col("_pairs").alias("pairs")))).alias("_windows")
        )
        lines = lines.select("_key", "_item", _longest(F.col("_same")).alias("_run"), F.explode(F.concat("_same", _agreeing(F.col("_windows")))).alias("_pos"))
        lines = lines.groupBy("_key", "_item", "_pos").agg(F.max("_run").alias("_run"))
        places = own.groupBy("_item", F.col("pos").alias("_pos")).agg((~F.min("lit")).cast("long").alias("_slim"))
        counts = places.groupBy("_item").agg(F.count("*").alias("_all"), F.sum("_slim").alias("_slims"))
        places, counts = (F.broadcast(x) if few else x for x in (places, counts))
        held = lines.join(places, ["_item", "_pos"]).groupBy("_key", "_item").agg(F.count("*").alias("n_windows"), F.sum("_slim").alias("_slim"), F.max("_run").alias("_run")).join(counts, "_item")
        share = F.greatest(F.col("n_windows") / F.col("_all"), F.when(F.col("_slims") > 0, F.col("_slim") / F.col("_slims")))
        words = F.when(F.col("_run") > 0, F.col("_run") + (n - 1)).otherwise(0)
        held = held.select("_key", "_item", "n_windows", share.alias("share"), words.cast("int").alias("run")).where((F.col("share") >= F.lit(cover)) | (F.col("run") >= F.lit(run)))
        found = held if found is None else found.unionByName(held)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "_key long, _item long, n_windows long, share double, run int")
    else:
        found = ws.cut(found, "found")
        ws.keep("found")
    return found.withColumnsRenamed({"_key": key, "_item": item})


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each document: kept is false if it holds an item; n_windows, max_share, longest_run and item_ids tell how much of which."""
    hit = matches(docs, benchmark).groupBy("doc_id").agg(F.sum("n_windows").alias("n_windows"), F.max("share").alias("max_share"), F.max("run").alias("longest_run"), F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    hit = hit.select("doc_id", "n_windows", "max_share", "longest_run", "item_ids", F.lit(True).alias("_hit"))
    out = docs.select("doc_id").join(hit, "doc_id", "left")
    return out.select("doc_id", F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"), F.coalesce("max_share", F.lit(0.0)).alias("max_share"), F.coalesce("longest_run", F.lit(0)).alias("longest_run"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.col("_hit").isNull().alias("kept"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows and columns of docs, without those that hold a benchmark item. Every row is judged by itself, also without a key."""
    ws = Workspace(docs.sparkSession, "drop_contaminated")
    rows = packed_rows(ws, docs)
    gone = ws.cut(matches(rows.select("uid", "text"), benchmark, key="uid").select("uid").distinct(), "gone")
    return select_ids(rows, gone, "left_anti", "uid").select("row.*")
