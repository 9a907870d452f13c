"""Near duplicates by bottom-k sketches of one hash function.

1. Each text becomes its set of shingle hashes; equal sets collapse into one node by a 128-bit digest, so copies cost no pairs.
2. The k least hashes of a set are its sketch; each value that several sketches retain makes an inverted list. If Jaccard is 0.75 or
   more, the least k values of the union hold least_shared(k) common ones or more but for a chance below 1e-11 (binomial, 7 standard
   deviations; at 0.75 exactly, less above), so two sketches meet among the rarest values that exceed k - least_shared(k) in
   number: only those make lists. Sets below k / 0.75 are exact here. Lists are kept by value and size level, as sizes of linked sets
   differ by a third at most.
3. A list never makes all its pairs: its members meet its least member. The sketch of the union estimates Jaccard and drops far
   pairs; full sets decide on the rest.
4. What then stands in a list of several components is open: a passage that many documents share, or copies with different edits.
   For open documents the full sets make inverted lists: the rarest shingles of a set, so many that a set of a given size band
   can't have enough in common with it and miss them all (an exact prefix bound, no chance in it). Of a list with several
   components, those outside its largest one meet all members of others; pairs inside a component decide nothing. Estimate and exact
   check follow as before. As bound and sizes go together, documents that share a passage of less than six sevenths of each don't meet.

Odd rows: a null or empty text has an empty set and is kept, linked with nothing; repeated rows are copies; rows with the same
key are one node of the result, and get one component, that of any of their texts; a null key is linked with nothing, has a null
component and is kept; very long texts are hashed in blocks and count whole; an empty table gives an empty one. Ties: the
smallest key stands for its component. Only key and text are read, whatever other columns there are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import hashing as H
from .workspace import Workspace, arrow_batches, freed, numbered, packed_rows, select_ids

K, SHINGLE, NEAR = 96, 5, 75
#: Size bands of the exact lists: each is so much wider than the one below.
BAND = 1.05


def least_shared(k: int, near: int = NEAR) -> int:
    """Common values among the k least of a union whose Jaccard is near percent: the mean less seven standard deviations."""
    p = near / 100
    return int(p * k - 7 * math.sqrt(k * p * (1 - p)))


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the n-word shingles; a text of fewer words has one for the whole sequence."""
    words = H.tokens((text or "").encode(), H.WORDS, H.ASCII_LOWER)[0]
    if not len(words):
        return np.zeros(0, np.int64)
    h = H.windows(words, min(n, len(words)))
    return np.unique(h >> np.uint64(1)).view(np.int64)


def _lists_of(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0] + [len(a) for a in arrays], dtype=np.int64).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64)))


def _sketched(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, hi, lo, sketch) of docs(doc_id, text)."""
    import xxhash

    def work(batches):
        for b in batches:
            size, hi, lo, least = [], [], [], []
            for text in b.column("text"):
                s = shingles(text.as_py())
                d = xxhash.xxh3_128_intdigest(s.tobytes())
                size.append(len(s))
                hi.append((d >> 64) - (1 << 63))
                lo.append((d & (1 << 64) - 1) - (1 << 63))
                least.append(s[:k])
            long = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), long(size), long(hi), long(lo), _lists_of(least)], ["doc_id", "n", "hi", "lo", "sketch"])

    return docs.mapInArrow(freed(work), "doc_id long, n long, hi long, lo long, sketch array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(doc_id, set) of docs(doc_id, text); set is the sorted hashes as bytes."""

    def work(batches):
        for b in batches:
            made = [shingles(t.as_py()).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "set"])

    return docs.mapInArrow(freed(work), "doc_id long, set binary")


def _postings(sets: DataFrame) -> DataFrame:
    """(doc_id, n, v) of each value of each set."""

    def work(batches):
        for b in batches:
            made = [np.frombuffer(s.as_py(), np.int64) for s in b.column("set")]
            size = pa.array([len(s) for s in made], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), size, _lists_of(made)], ["doc_id", "n", "v"])

    return sets.mapInArrow(freed(work), "doc_id long, n long, v array<long>").select("doc_id", "n", F.explode("v").alias("v"))


def _exact(pairs: DataFrame, near: int) -> DataFrame:
    """The pairs (a, b) of (a, b, set_a, set_b) with 100 * intersection >= near * union."""

    def work(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a"), b.column("set_b")):
                x, y = np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= near * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "set_a", "set_b").mapInArrow(freed(work), "a long, b long")


def verified(ws: Workspace, name: str, pairs: DataFrame, nodes: DataFrame, sets: DataFrame, k: int, near: int) -> DataFrame:
    """The pairs (a, b) that full sets confirm, after the estimate of the union's sketch. sets has (doc_id, set) of all ends at least."""
    side = lambda s: nodes.select(F.col("doc_id").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"k_{s}"))
    p = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= near * F.greatest("n_a", "n_b"))
    both = F.size(F.array_intersect("k_a", "k_b"))
    p = p.withColumn("u", F.slice(F.array_sort(F.array_union("k_a", "k_b")), 1, k))
    shared = F.size(F.array_intersect(F.array_intersect("k_a", "k_b"), "u"))
    whole = (F.col("n_a") <= k) & (F.col("n_b") <= k)
    p = p.where(F.when(whole, 100 * both >= near * (F.col("n_a") + F.col("n_b") - both)).otherwise(k * shared >= least_shared(k, near) * F.size("u")))
    p = ws.cut(p.select("a", "b", whole.alias("sure")), f"{name}_near")
    one = lambda s: sets.select(F.col("doc_id").alias(s), F.col("set").alias(f"set_{s}"))
    full = p.where(~F.col("sure")).join(one("a"), "a").join(one("b"), "b")
    return ws.cut(p.where("sure").select("a", "b").unionByName(_exact(full, near)), f"{name}_links")


def components(ws: Workspace, name: str, links: DataFrame) -> DataFrame:
    """(doc_id, comp) of all linked nodes; comp is the least node reachable.

    Each round a node takes the least label among its own and its neighbours', then the label of that label, so paths
    shrink by half; rounds end as no label changes.
    """
    both = ws.cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), f"{name}_both")
    label = ws.cut(both.groupBy(F.col("a").alias("doc_id")).agg(F.least("doc_id", F.min("b")).alias("comp")), f"{name}_0")
    i = 0
    while True:
        i += 1
        told = both.join(label.select(F.col("doc_id").alias("b"), "comp"), "b").groupBy(F.col("a").alias("doc_id")).agg(F.min("comp").alias("near"))
        new = label.join(told, "doc_id").select("doc_id", F.col("comp").alias("was"), F.least("comp", "near").alias("mid"))
        jump = label.select(F.col("doc_id").alias("mid"), F.col("comp").alias("far"))
        new = new.join(jump, "mid", "left").select("doc_id", "was", F.least("mid", F.coalesce("far", "mid")).alias("comp"))
        new = ws.cut(new, f"{name}_{i}")
        done = new.where("was != comp").isEmpty()
        ws.drop(f"{name}_{i - 1}")
        label = new.select("doc_id", "comp")
        if done:
            ws.drop(f"{name}_both")
            return label


def _ranked(posts: DataFrame, size: Column) -> DataFrame:
    """posts(doc_id, n, v) of values that several nodes have, with rank: the value's place in its set of size values, rarest first."""
    posts = posts.join(posts.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "v")
    w = Window.partitionBy("doc_id", "n")
    return posts.withColumn("rank", F.row_number().over(w.orderBy("df", "v")) + size - F.count("*").over(w))


def _part(n: Column, near: int) -> Column:
    """The least size of a set that can be linked with one of n, and what they have in common at least."""
    return F.ceil(n * near / 100)


def _lists(nodes: DataFrame, k: int, near: int) -> DataFrame:
    """(key, doc_id): the inverted lists of sketches; key stands for a value and a size level, each node is at its own level and the next."""
    kept = F.least(F.col("n"), F.lit(k))
    posts = _ranked(nodes.select("doc_id", "n", F.explode("sketch").alias("v")), kept)
    need = F.when(F.col("n") * 100 <= near * k, _part(F.col("n"), near)).otherwise(F.least(F.lit(least_shared(k, near)), _part(F.col("n"), near)))
    level = F.floor(F.log("n") / math.log(100 / near)).cast("int")
    posts = posts.where(F.col("rank") <= kept - need + 1).select("doc_id", "v", F.explode(F.array(level, level + 1)).alias("level"))
    return posts.select(F.xxhash64("v", "level").alias("key"), "doc_id")


def _banded(posts: DataFrame, near: int) -> DataFrame:
    """(key, doc_id, side): inverted lists of full sets by value and pair of size bands; side tells the lower (1) and upper (2) band, 0 if they are one.

    Sets of n and m values need near / (100 + near) of n + m in common, m being at least its band's lower end. Of two sets that
    have so many in common, put in one order of all values, the first n - need + 1 values of each hold a common one.
    """
    n, other = F.col("n"), F.col("other")
    band = lambda size: F.floor(F.log(size) / math.log(BAND)).cast("int")
    posts = _ranked(posts, n).where(F.col("rank") <= n - _part(n, near) + 1)
    posts = posts.withColumn("own", band(n)).withColumn("other", F.explode(F.sequence(band(_part(n, near)), band(F.floor(n * 100 / near)))))
    least = F.greatest(F.ceil(F.pow(F.lit(BAND), other) * (1 - 1e-9)), _part(n, near))
    need = F.greatest(_part(n, near), F.ceil(near * (n + least) / (100 + near)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(lo == hi, 0).when(F.col("own") == lo, 1).otherwise(2)
    return posts.where(F.col("rank") <= n - need + 1).select(F.xxhash64("v", lo, hi).alias("key"), "doc_id", side.alias("side"))


def _placed(lists: DataFrame, comp: DataFrame) -> DataFrame:
    """lists with comp, the component of each member; a node without a link is one by itself."""
    return lists.join(comp, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))


def _apart(ws: Workspace, lists: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, doc_id, side, comp, main) of lists that hold several components and not one side alone; main is the largest component.

    Of lists with the same members, as the values of one passage have, one stands for all.
    """
    placed = ws.cut(_placed(lists, comp), "placed")
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("m"), F.min("side").alias("low"), F.max("side").alias("high"), F.bit_xor(F.xxhash64("doc_id", "side", F.lit(1))).alias("x"), F.bit_xor(F.xxhash64("doc_id", "side", F.lit(2))).alias("y"))
    parts = parts.groupBy("key").agg(F.max_by("comp", F.struct("m", -F.col("comp"))).alias("main"), F.count("*").alias("parts"), F.sum("m").alias("m"), F.min("low").alias("low"), F.max("high").alias("high"), F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    parts = parts.where("parts > 1 and (low = 0 or low < high)").groupBy("x", "y", "m").agg(F.min(F.struct("key", "main")).alias("one")).select("one.*")
    return ws.cut(placed.join(parts, "key"), "apart")


def _cross(apart: DataFrame) -> DataFrame:
    """(a, b): the members outside a list's main component with all of other components, on the other side where lists have two."""
    across = F.when(F.col("side") == 0, 0).otherwise(3 - F.col("side"))
    rest = apart.where("comp != main").select("key", across.alias("side"), F.col("doc_id").alias("x"), F.col("comp").alias("cx"))
    other = apart.select("key", "side", F.col("doc_id").alias("y"), F.col("comp").alias("cy"), (F.col("comp") == F.col("main")).alias("inside"))
    pairs = rest.join(other, ["key", "side"]).where((F.col("cx") != F.col("cy")) & (F.col("inside") | (F.col("x") < F.col("y"))))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()


def linked(ws: Workspace, docs: DataFrame, k: int = K, near: int = NEAR, more: DataFrame | None = None) -> DataFrame:
    """(doc_id, n, comp) of docs(doc_id, text), whose doc_id are distinct and not null; more: further links (a, b). n is the set's size."""
    rows = ws.cut(_sketched(docs, k), "rows")
    nodes = rows.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("m"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = ws.cut(nodes, "nodes")
    copies = rows.where("n > 0").join(nodes.where("m > 1").select("hi", "lo", F.col("doc_id").alias("a")), ["hi", "lo"]).select("a", F.col("doc_id").alias("b")).where("a != b")
    lists = ws.cut(_lists(nodes, k, near), "lists")
    heads = lists.groupBy("key").agg(F.min("doc_id").alias("a"), F.count("*").alias("m")).where("m > 1").select("key", "a")
    stars = ws.cut(lists.join(heads, "key").where("doc_id != a").select("a", F.col("doc_id").alias("b")).distinct(), "stars")
    ends = ws.cut(_ends(stars), "ends")
    close = ws.cut(select_ids(nodes.select("doc_id", "n", "sketch"), ends, "left_semi"), "close")
    sets = ws.cut(_sets(select_ids(docs, ends, "left_semi")), "sets")
    links = verified(ws, "star", stars, close, sets, k, near)
    comp = components(ws, "first", links)
    placed = _placed(lists, comp)
    torn = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("key")
    crowd = ws.cut(placed.join(torn, "key").select("doc_id").distinct(), "crowd")  # each of them is in a star, so its set is at hand
    exact = _banded(ws.cut(_postings(select_ids(sets, crowd, "left_semi")), "postings"), near)
    cross = ws.cut(_cross(_apart(ws, exact, comp)), "cross")
    all_links = links.unionByName(verified(ws, "cross", cross, close, sets, k, near)).unionByName(copies)
    comp = components(ws, "last", all_links if more is None else all_links.unionByName(more))
    return rows.select("doc_id", "n").join(comp, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id"))


def classes(docs: DataFrame, k: int = K, near: int = NEAR) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id long, text)."""
    arrow_batches(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "neardup")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    single, odd = numbered(ws, docs, "doc_id", with_null=False)
    rows = lambda df: df.select(F.col("uid").alias("doc_id"), "text")
    if odd is None:
        out = linked(ws, rows(single), k, near).select("doc_id", "n", "comp")
    else:
        firsts = odd.groupBy("doc_id").agg(F.min("uid").alias("a"))
        same = odd.join(firsts, "doc_id").select("a", F.col("uid").alias("b")).where("a != b")
        found = ws.cut(linked(ws, rows(single).unionByName(rows(odd)), k, near, same), "numbers")
        names = odd.select(F.col("doc_id").alias("key"), F.col("uid").alias("doc_id"))
        found = found.join(names, "doc_id", "left").select(F.coalesce("key", "doc_id").alias("doc_id"), "n", "comp")
        least = found.groupBy("comp").agg(F.min("doc_id").alias("least"))
        out = found.join(least, "comp").select("doc_id", "n", F.col("least").alias("comp"))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), (F.col("doc_id") == F.col("comp")).alias("kept"))
    nameless = _sketched(docs.where(F.col("doc_id").isNull()), k).select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    out = ws.cut(out.unionByName(nameless), "result")
    ws.keep("result")
    return out


def drop_near(docs: DataFrame, k: int = K, near: int = NEAR) -> DataFrame:
    """The rows and columns of docs, with one row of each component.

    Here every row is a node of its own, also those that repeat a key or have none, so of equal rows one stays. It is the row with
    the smallest key; rows with a null or repeated key come after all others.
    """
    arrow_batches(docs.sparkSession)
    ws = Workspace(docs.sparkSession, "drop_near")
    rows = packed_rows(ws, docs)
    found = linked(ws, rows.select(F.col("uid").alias("doc_id"), "text"), k, near)
    gone = ws.cut(found.where("doc_id != comp").select(F.col("doc_id").alias("uid")), "gone")
    ws.keep("gone", "odd", "twice")
    return select_ids(rows, gone, "left_anti", "uid").select("row.*")
