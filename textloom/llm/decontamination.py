"""Benchmark decontamination by spaced seeds, in DataFrame operations only.

A mask reads some of ``SPAN`` consecutive words and ignores the others, so a seed survives substitutions at the
ignored places. Seeds of documents and benchmark items are joined on their hash; each hit names an item and a
diagonal (the document position at which the item would begin), and carries the words around it on either side, which
are compared in place. So hits alone are shuffled, never texts.

Items shorter than a window are found by their first and last four words, one of which a substitution leaves as it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import bound, discard, free_names, written

#: Any 13 words with two substitutions hold one of these seeds at some place (checked by enumeration in the tests).
MASKS = ("11110011", "11010111")
SPAN = 8
#: What is read at the ends of an item shorter than a window, and from how many words on one may differ.
SHORT_MASK, TOLERANT = "1111", 8
#: A benchmark of no more seeds than this is sent to every executor (some 250 bytes each); a larger one is shuffled.
BROADCAST_SEEDS = 300_000


def words_of(text: Column) -> Column:
    """Hashes of the lower-case words (runs of letters and digits) of the whole text."""
    return F.transform(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w))


def _seed(k: int, mask: str, words: Column, at: Column) -> Column:
    """Null where the mask doesn't fit."""
    return F.when(at + len(mask) <= F.size(words), F.xxhash64(F.lit(k), *[F.get(words, at + j) for j, c in enumerate(mask) if c == "1"]))


def _around(words: Column, radius: int) -> Column:
    """The words with so many nulls on either side, so that a slice has the words around a place in its middle."""
    nulls = F.array_repeat(F.lit(None).cast("long"), radius)
    return F.concat(nulls, words, nulls)


def _item_seeds(benchmark: DataFrame, window: int, item_id_col: str, item_text_col: str) -> DataFrame:
    """``seed, item_id, item_at, item_words`` (those around the seed) and ``n_words`` of each item of four words or more."""
    items = benchmark.select(F.col(item_id_col).alias("item_id"), words_of(F.col(item_text_col)).alias("words")).where(F.size("words") >= len(SHORT_MASK))
    words, n = F.col("words"), F.size("words")
    at = lambda k, mask: lambda i: F.struct(i.alias("item_at"), _seed(k, mask, words, i).alias("seed"))
    long = F.concat(*[F.transform(F.sequence(F.lit(0), F.greatest(n - len(mask), F.lit(0))), at(k, mask)) for k, mask in enumerate(MASKS)])
    ends = F.when(n >= TOLERANT, F.array(F.lit(0), n - len(SHORT_MASK))).otherwise(F.array(F.lit(0)))
    short = F.transform(ends, at(len(MASKS), SHORT_MASK))
    each = items.select("item_id", "words", F.explode(F.when(n < window, short).otherwise(long)).alias("_s"))
    return each.select("_s.seed", "item_id", "_s.item_at", F.slice(_around(F.col("words"), window - 1), F.col("_s.item_at") + 1, 2 * window - 1).alias("item_words"), F.size("words").alias("n_words")).where("seed is not null")


def _hits(docs: DataFrame, benchmark: DataFrame, window: int, matches: int, id_col: str, text_col: str, item_id_col: str, item_text_col: str) -> DataFrame:
    """``doc_id, k1, k2, item_id, at, agreeing`` of each document and item with a window that agrees; k1 and k2 name the row."""
    seeds = written(_item_seeds(benchmark, window, item_id_col, item_text_col), "benchmark-seeds")
    masks = list(enumerate(MASKS))
    if not seeds.where(F.col("n_words") < window).isEmpty():
        masks.append((len(MASKS), SHORT_MASK))
    least = min(len(m) for _, m in masks)
    of = lambda w: F.when(F.size(w) >= least, F.flatten(F.transform(F.sequence(F.lit(0), F.size(w) - least), lambda i: F.array(*[_seed(k, m, w, i) for k, m in masks]))))
    name = F.xxhash64(id_col, text_col).alias("k1"), F.xxhash64(F.lit(1), id_col, text_col).alias("k2")
    read = docs.select(F.col(id_col).alias("doc_id"), *name, words_of(F.col(text_col)).alias("words"))
    # the seeds are a column before they are exploded, and the words around one are cut out after the join: so the
    # explode and the join are one generated loop, in which no array is copied. The outer form has no guard that
    # computes the seeds once more
    seeded = read.select("doc_id", "k1", "k2", _around(F.col("words"), window - 1).alias("words"), bound(F.col("words"), of).alias("seeds"))
    each = seeded.select("doc_id", "k1", "k2", "words", F.posexplode_outer("seeds").alias("_at", "seed"))
    place = F.floor(F.col("_at") / len(masks)).cast("int")
    if seeds.count() <= BROADCAST_SEEDS:
        met = each.join(F.broadcast(seeds), "seed")
    else:
        narrow = each.where("seed is not null").select("k1", "k2", "_at", "seed").join(seeds, "seed").distinct()
        met = seeded.drop("seeds").join(narrow, ["k1", "k2"])
    near = met.select("doc_id", "k1", "k2", "item_id", (place - F.col("item_at")).alias("at"), "n_words", F.slice("words", place + 1, 2 * window - 1).alias("here"), "item_words")
    agree = F.zip_with("here", "item_words", lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int"))
    best = bound(agree, lambda a: F.array_max(F.transform(F.sequence(F.lit(1), F.lit(window)), lambda i: F.aggregate(F.slice(a, i, window), F.lit(0), lambda s, x: s + x))))
    needed = F.when(F.col("n_words") >= window, matches).when(F.col("n_words") >= TOLERANT, F.col("n_words") - 1).otherwise(F.col("n_words"))
    # what agrees is judged after the aggregation: a filter before it would become part of the join and end the loop
    each = near.select("doc_id", "k1", "k2", "item_id", "at", best.alias("agreeing"), needed.alias("_needed"))
    found = each.groupBy("doc_id", "k1", "k2", "item_id", "at").agg(F.max("agreeing").alias("agreeing"), F.min("_needed").alias("_needed"))
    return found.where("agreeing >= _needed").drop("_needed")


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, matches: int = 11, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id, at, agreeing``: every document that repeats a passage of a benchmark item.

    A passage is ``window`` consecutive words of the item of which at least ``matches`` agree, in place, with the
    document's (two substitutions in 13 words are always found). Of an item of fewer words all but one must agree, and
    all where it has fewer than 8. ``agreeing`` is the most that do and ``at`` the word at which the item begins (the
    document may hold only a later part, so it can be negative).

    Items of fewer than 4 words are no evidence and match nothing. Null and empty texts on either side match nothing.
    Very long texts are read whole. Rows of equal id and text share the rows of the result; rows with null ids are
    reported too. Equal items are each reported. Empty tables give an empty result. Other columns of either table
    aren't read.
    """
    return _hits(docs, benchmark, window, matches, id_col, text_col, item_id_col, item_text_col).select("doc_id", "item_id", "at", "agreeing")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, matches: int = 11, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that repeat no passage of the benchmark (as in
    ``find_contamination``)."""
    a, b = free_names(docs, "_k1", "_k2")
    # small enough for Spark to broadcast it or not, by its size on disk
    bad = written(_hits(docs, benchmark, window, matches, id_col, text_col, item_id_col, item_text_col).select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct(), "contaminated")
    same = (F.xxhash64(docs[id_col], docs[text_col]) == bad[a]) & (F.xxhash64(F.lit(1), docs[id_col], docs[text_col]) == bad[b])
    return docs.join(bad, same, "left_anti")
