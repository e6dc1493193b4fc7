"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

1. One pass over the texts makes each row's text key (128 bits) and band hashes; equal texts are one text from here.
2. Texts that share a band hash are candidates. A text is at home in the most frequent band of any of them; the texts
   of a home are dealt into blocks of a fixed size, and each meets the blocks of all texts with which it shares a band.
3. The n-gram sets of candidates alone are made, sent to each pair of blocks that meets, and compared inside tasks; a
   task gives back the number of links of each text and a spanning forest of its links, never the pairs.
4. Classes are the components of those forests.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.components import connected_components
from textloom.llm.shared import discard, free_names, written

_WORD = re.compile(r"\w+")
_MEMO_LIMIT = 100_000
AT_ONCE = 250
#: Word n-grams hashed at once, so that they stay in a core's cache.
_STRETCH = 1 << 15


def choose_bands(threshold: float, recall: float, hashes: int) -> tuple[int, int]:
    """The most rows a band, and the bands then needed, so that a pair at the threshold shares a band with at least
    the probability ``recall`` within so many hashes."""
    fits = [(rows, bands) for rows in range(1, hashes + 1) if rows * (bands := math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))) <= hashes]
    if not fits:
        raise ValueError("too few hashes for this recall")
    return fits[-1]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Hashes of a text's word n-grams. A text of fewer words has one, of all its words; one without words has none."""

    def __init__(self, n: int):
        from xxhash import xxh64_intdigest

        self.n, self.hash_word = n, xxh64_intdigest
        self.memo: dict[str, int] = {}

    def words(self, text: str | None) -> np.ndarray:
        found = _WORD.findall(text.lower()) if text else []
        memo, get = self.memo, self.memo.get
        if len(memo) > _MEMO_LIMIT:
            memo.clear()
        out = [get(w) for w in found]
        if None in out:
            for i, h in enumerate(out):
                if h is None:
                    out[i] = memo[found[i]] = self.hash_word(found[i])
        return np.array(out, np.uint64)

    def shingles(self, text: str | None) -> np.ndarray:
        w = self.words(text)
        n = min(self.n, len(w))
        if not n:
            return w
        h = np.zeros(len(w) - n + 1, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + w[k : len(w) - n + 1 + k]
        return _mix(h)


def signatures(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash values (texts, hashes) of texts that have at least one n-gram."""
    out = np.empty((len(sets), len(a)), np.uint64)
    at = 0
    while at < len(sets):
        end, room = at, 0
        while end < len(sets) and (end == at or room + len(sets[end]) <= _STRETCH):
            room += len(sets[end])
            end += 1
        joined = np.concatenate(sets[at:end])
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : end - 1]])]).astype(np.int64)
        if end - at == 1 and room > _STRETCH:
            parts = [signatures([joined[k : k + _STRETCH]], a, b)[0] for k in range(0, room, _STRETCH)]
            out[at] = np.min(parts, axis=0)
        else:
            for k in range(len(a)):
                out[at:end, k] = np.minimum.reduceat(joined * a[k] + b[k], starts)
        at = end
    return out


def _sign(docs: DataFrame, n: int, rows: int, bands: int) -> DataFrame:
    """``doc_id, key, n_words, bands`` for each row. Rows without an id or a word have no key and no bands."""

    @F.pandas_udf("key binary, n_words int, bands array<long>")
    def sign(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(n)
        draw = np.random.default_rng(20)
        a = draw.integers(1 << 62, 1 << 63, rows * bands, np.uint64) * np.uint64(2) + np.uint64(1)
        b = draw.integers(0, 1 << 63, rows * bands, np.uint64)
        spread = draw.integers(1 << 62, 1 << 63, (bands, rows), np.uint64) * np.uint64(2) + np.uint64(1)
        for texts in (b.iloc[k : k + AT_ONCE] for b in batches for k in range(0, len(b), AT_ONCE)):
            sets = [shingler.shingles(t) for t in texts]
            some = [i for i, s in enumerate(sets) if len(s)]
            keys: list[bytes | None] = [None] * len(sets)
            band: list[np.ndarray] = [np.zeros(0, np.int64)] * len(sets)
            if some:
                values = _mix(signatures([sets[i] for i in some], a, b)).reshape(len(some), bands, rows)
                own = _mix((values * spread).sum(2) + np.arange(bands, dtype=np.uint64)).view(np.int64)
                for k, i in enumerate(some):
                    keys[i], band[i] = hashlib.md5(texts.iloc[i].encode("utf-8", "surrogatepass")).digest(), own[k]
            yield pd.DataFrame({"key": keys, "n_words": [len(s) for s in sets], "bands": band})

    signed = docs.select("doc_id", sign(F.when(F.col("doc_id").isNotNull(), F.col("text"))).alias("_s"))
    return signed.select("doc_id", "_s.*")


def compare_block(keys: list[bytes], sets: list[np.ndarray], first: np.ndarray, threshold: float) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Links of each text, and a spanning forest of them. first: of the first block; only pairs across the two blocks
    count, or all if every text is of the first."""
    order = np.argsort(~first, kind="stable")
    n_first = int(first.sum())
    n = len(keys)
    ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)[1]
    sizes = np.array([len(sets[i]) for i in order])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    links = np.zeros(n, np.int64)
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    forest = []
    mark = np.zeros(int(ids.max()) + 1, bool)
    for p in range(n_first):
        low = n_first if n_first < n else p + 1
        if low >= n:
            break
        own = ids[starts[p] : starts[p] + sizes[p]]
        mark[own] = True
        shared = np.add.reduceat(mark[ids[starts[low] :]].astype(np.int32), starts[low:] - starts[low])
        mark[own] = False
        near = np.flatnonzero(shared >= threshold * (sizes[p] + sizes[low:] - shared) - 1e-9) + low
        links[p] += len(near)
        links[near] += 1
        for q in near.tolist():
            x, y = find(p), find(q)
            if x != y:
                root[x] = y
                forest.append((p, q))
    out = np.zeros(n, np.int64)
    out[order] = links
    return out, [(int(order[p]), int(order[q])) for p, q in forest]


def _meetings(texts: DataFrame, block_texts: int, block_ngrams: int) -> DataFrame:
    """``key, rep, block, meets`` of texts that share a band: their block, and the pairs of blocks in which they are compared.

    A text is at home in the most frequent band of any text with which it shares one. The texts of a home are dealt into
    blocks of a fixed size, and a text meets a block if one of its bands has a text of that block. So any two texts that
    share a band meet in one pair of blocks and in no other, and texts that only a chain of bands connects don't meet
    unless they are at home together.
    """
    banded = texts.select("key", F.explode("bands").alias("band"))
    # tables of their own, so that Spark can split a frequent band when they are joined
    met = banded.groupBy("band").agg(F.min("key").alias("_a"), F.max("key").alias("_z"), F.count("*").alias("n")).where("_a <> _z")
    buckets = written(met.select("band", F.struct("n", "band").alias("_own")), "bands")
    shared = written(banded.join(buckets, "band").select("key", "band", "_own"), "shared-bands")
    own = shared.groupBy("key").agg(F.max("_own").alias("_own"))
    best = written(shared.select("key", "band").join(own, "key").groupBy("band").agg(F.max("_own").alias("_home")), "homes-of-bands")
    home = shared.select("key", "band").join(best, "band").groupBy("key").agg(F.max("_home").alias("_home")).select("key", F.col("_home.band").alias("home"))
    home = written(home.join(texts.select("key", "rep", "n_words"), "key"), "homes")
    sizes = written(home.groupBy("home").agg(F.greatest(F.ceil(F.count("*") / block_texts), F.ceil(F.sum("n_words") / block_ngrams)).cast("int").alias("blocks")), "home-sizes")
    placed = written(home.join(sizes, "home").select("key", "rep", F.xxhash64("home", F.pmod(F.xxhash64("key"), F.col("blocks"))).alias("block")), "blocks")
    inside = shared.select("key", "band").join(placed.select("key", "block"), "key")
    # a band has few blocks beside its texts: those that they fill, and those of more frequent bands
    several = written(inside.groupBy("band").agg(F.collect_set("block").alias("_blocks")).where(F.size("_blocks") > 1), "blocks-of-bands")
    # a text has a fixed number of bands, which bounds the list
    others = inside.join(several, "band").groupBy("key").agg(F.array_distinct(F.flatten(F.collect_list("_blocks"))).alias("_blocks"))
    pair = lambda x: F.struct(F.least("block", x).alias("i"), F.greatest("block", x).alias("j"))
    meets = F.transform(F.array_union(F.array("block"), F.coalesce("_blocks", F.array().cast("array<long>"))), pair)
    made = written(placed.join(others, "key", "left").select("key", "rep", "block", meets.alias("meets")), "meetings")
    discard(buckets, shared, best, home, sizes, placed, several)
    return made


def _verify(docs: DataFrame, meetings: DataFrame, n: int, threshold: float) -> DataFrame:
    """``key, other, links``: rows with ``other`` are links of a spanning forest, the others count links."""

    @F.pandas_udf("binary")
    def ngrams(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shingler = Shingler(n)
        for texts in (b.iloc[k : k + AT_ONCE] for b in batches for k in range(0, len(b), AT_ONCE)):
            yield pd.Series([np.unique(shingler.shingles(t)).tobytes() for t in texts])

    # the meetings grow with the texts, so they are never broadcast
    read = docs.withColumn("key", F.unhex(F.md5(F.col("text").cast("binary")))).join(meetings.withColumnRenamed("rep", "doc_id").hint("merge"), ["doc_id", "key"])
    own = read.select("key", "block", "meets", ngrams(F.col("text")).alias("ngrams"))
    met = own.select("key", "block", "ngrams", F.explode("meets").alias("_m")).select("key", "block", "ngrams", "_m.i", "_m.j")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("key")
        keys = pdf["key"].tolist()
        first = (pdf["block"] == pdf["i"]).to_numpy()
        # where one of two blocks is empty, the other's own pairs are those of another task
        if len(keys) < 2 or not first.any() or (pdf["i"].iloc[0] != pdf["j"].iloc[0] and first.all()):
            return pd.DataFrame({"key": [], "other": [], "links": []})
        links, forest = compare_block(keys, [np.frombuffer(x, np.uint64) for x in pdf["ngrams"]], first, threshold)
        some = np.flatnonzero(links)
        return pd.DataFrame({"key": [keys[p] for p, _ in forest] + [keys[k] for k in some], "other": [keys[q] for _, q in forest] + [None] * len(some), "links": [0] * len(forest) + links[some].tolist()})

    return met.groupBy("i", "j").applyInPandas(compare, "key binary, other binary, links long")


def near_duplicate_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, hashes: int = 128, block_texts: int = 150, block_ngrams: int = 400_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, key, class_id, class_key, n_copies, n_links`` for every row.

    Texts are linked if the Jaccard similarity of their word n-gram sets (lower case; runs of letters, digits and
    underscores) is at least ``threshold``; a class is what links and equal texts connect. ``class_id`` is the least
    id in the class, ``n_copies`` the rows of equal text, ``n_links`` the other texts linked to this one (copies of
    a text count once). A pair at the threshold is found with probability ``recall`` or more, a closer one more
    surely; what is found is decided on full sets.

    A text of fewer than ``n`` words has one n-gram, of all its words. Null, empty and wordless texts, and rows
    without an id, are classes of their own with no links (their ``key`` is null). Very long texts are hashed in
    stretches and fill blocks of their own. Repeated rows are copies. An empty table gives an empty result. Other
    columns aren't read.
    """
    rows, bands = choose_bands(threshold, recall, hashes)
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(_sign(docs, n, rows, bands), "signatures")
    # copies of a text are one from here, so that a large group of them is no frequent band
    texts = written(signed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_copies"), F.max("n_words").alias("n_words"), F.first("bands").alias("bands")), "texts")
    meetings = _meetings(texts, block_texts, block_ngrams)
    verified = written(_verify(docs, meetings, n, threshold), "links")
    classes = connected_components(verified.where("other is not null"), "key", "other").withColumnRenamed("node", "key").withColumnRenamed("component", "class")
    counts = verified.where("other is null").groupBy("key").agg(F.sum("links").alias("n_links"))
    known = texts.drop("bands").join(classes, "key", "left").join(counts, "key", "left").withColumn("class", F.coalesce("class", "key"))
    known = written(known.select("key", "rep", "n_copies", "class", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")), "classes")
    discard(texts, meetings, verified)
    heads = known.groupBy("class").agg(F.min(F.struct("rep", "key")).alias("_head"))
    per_text = known.join(heads, "class").select("key", "n_copies", "n_links", F.col("_head.rep").alias("class_id"), F.col("_head.key").alias("class_key"))
    return signed.select("doc_id", "key").join(per_text, "key", "left").select("doc_id", "key", F.coalesce("class_id", "doc_id").alias("class_id"), "class_key", F.coalesce("n_copies", F.lit(1)).alias("n_copies"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def keep_one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, but one of each class: the one with the least id (of a
    repeated row, one).

    Rows that are classes of their own, as null texts, all stay. An empty table stays empty.
    """
    classes = written(near_duplicate_classes(docs, id_col=id_col, text_col=text_col, **options).where("class_key is not null"), "classes")
    head = (F.col("doc_id") == F.col("class_id")) & (F.col("key") == F.col("class_key"))
    once = classes.groupBy("doc_id", "key").agg(F.first(head).alias("_head"), F.count("*").alias("_times")).where("not _head or _times > 1")
    id_name, key_name = free_names(docs, "_id", "_key")
    odd = written(once.select(F.col("doc_id").alias(id_name), F.col("key").alias(key_name), F.col("_head").alias("head")), "odd-rows")
    discard(classes)
    at = (docs[id_col] == odd[id_name]) & (F.unhex(F.md5(docs[text_col].cast("binary"))) == odd[key_name])
    kept = docs.join(odd, at, "left_anti")
    heads = odd.where("head").select(id_name, key_name)
    if not heads.isEmpty():
        repeated = docs.join(heads, (docs[id_col] == heads[id_name]) & (F.unhex(F.md5(docs[text_col].cast("binary"))) == heads[key_name]), "left_semi")
        kept = kept.union(repeated.dropDuplicates([id_col, text_col]))
    return kept
