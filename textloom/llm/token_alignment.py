"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts.

Tokens of either tokenizer cut a text at byte offsets. A common offset near the middle of an interval, found by bisecting
the other tokenizer's ends, divides it into two that are aligned in the same way; an interval without one is a leaf, a
group of tokens of both. All intervals of one depth are bisected together, those of many documents at once.

Tokens whose byte ranges overlap are linked. How many documents link two ids is counted over the corpus; what each
document's links come to beside these counts is found by dealing links and counts by the first id.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.shared import written

VOCABULARY_A, VOCABULARY_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: How byte-level BPE vocabularies of this kind cut texts (fixed value, part of the vocabulary).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of the texts that are aligned at once.
CHUNK_BYTES = 1 << 20
#: Parts, by the first id, in which links meet their counts, and links of a part that one task takes.
PARTS, PART_LINKS = 16, 2_000_000
#: Ends that are tried one by one, about the middle of an interval, before all of it are.
NEAR = 16


class ByteBpe:
    """The byte-level tokenizer of a JSON file whose merges are in the order of their ids."""

    def __init__(self, file: bytes, pattern: str = PRE_TOKENS):
        import tiktoken

        model = json.loads(file)
        special = {t["id"] for t in model["added_tokens"]}
        # bytes that print stand for themselves in such files, the others for the characters from 256 on
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        of = {chr(b): b for b in printed} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(printed)))}
        ranks = {bytes(of[c] for c in token): k for token, k in model["model"]["vocab"].items() if k not in special}
        if any(ranks.get(bytes(of[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))) != 256 + k for k, m in enumerate(model["model"]["merges"])):
            raise ValueError("merges aren't in the order of their ids")
        self.n_ids = max(ranks.values()) + 1
        self.bytes_of = [b""] * self.n_ids
        for token, k in ranks.items():
            self.bytes_of[k] = token
        self.encoding = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self.encoding.encode_ordinary(" " + t) for t in texts]


class PieceBpe:
    """The sentencepiece tokenizer of a model file, which puts a space before the text itself."""

    def __init__(self, file: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        self.n_ids = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(k) for k in range(self.n_ids)]
        self.bytes_of = [bytes([int(p[3:5], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def shared_cuts(a: np.ndarray, b: np.ndarray, a_stops: np.ndarray, b_stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the equal ends in ``a`` and in ``b``, both rising. Intervals end before ``a_stops`` and ``b_stops``,
    where the ends are equal."""
    found_a, found_b = [a_stops - 1], [b_stops - 1]
    lo, hi = np.concatenate([[0], a_stops[:-1]]), a_stops
    b_lo, b_hi = np.concatenate([[0], b_stops[:-1]]), b_stops
    step = np.zeros(len(lo), np.int64)
    while len(lo):
        # one token on either side is a leaf; step 0, 1, 2, 3 ... tries the middle, +1, -1, +2 ...
        middle = (lo + hi - 2) >> 1
        at = middle + np.where(step & 1, (step + 1) >> 1, -(step >> 1))
        inside = (at >= lo) & (at < hi - 1)
        safe = np.where(inside, at, lo)
        meets = np.searchsorted(b, a[safe])
        hit = inside & (b[np.minimum(meets, len(b) - 1)] == a[safe])
        far = ~hit & (step >= NEAR)
        for k in np.flatnonzero(far):  # few: nothing was shared about the middle, so all the interval is tried
            own = a[lo[k] : hi[k] - 1]
            there = b_lo[k] + np.searchsorted(b[b_lo[k] : b_hi[k]], own)
            equal = np.flatnonzero(b[np.minimum(there, len(b) - 1)] == own)
            if len(equal):
                best = equal[np.argmin(np.abs(equal + lo[k] - middle[k]))]
                at[k], meets[k], hit[k] = lo[k] + best, there[best], True
        found_a.append(at[hit])
        found_b.append(meets[hit])
        left = lo[hit], at[hit] + 1, b_lo[hit], meets[hit] + 1
        right = at[hit] + 1, hi[hit], meets[hit] + 1, b_hi[hit]
        wait = ~hit & ~far & (step <= hi - lo)  # both sides of the middle are tried by then
        again = lo[wait], hi[wait], b_lo[wait], b_hi[wait]
        lo, hi, b_lo, b_hi = (np.concatenate(x) for x in zip(left, right, again, strict=True))
        step = np.concatenate([np.zeros(2 * int(hit.sum()), np.int64), step[wait] + 1])
        open_ = (hi - lo > 1) & (b_hi - b_lo > 1)
        lo, hi, b_lo, b_hi, step = lo[open_], hi[open_], b_lo[open_], b_hi[open_], step[open_]
    cuts_a, cuts_b = np.concatenate(found_a), np.concatenate(found_b)
    order = np.argsort(cuts_a)
    return cuts_a[order], cuts_b[order]


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all tokens of ``a`` and ``b`` (their ends) that share a byte; both end at the same offset."""
    last = np.searchsorted(b, a)  # the token of b in which a's ends
    first = np.concatenate([[0], (last + (b[last] == a))[:-1]])
    n = last - first + 1
    of_a = np.repeat(np.arange(len(a)), n)
    return of_a, np.arange(len(of_a)) - np.repeat(np.cumsum(n) - n - first, n)


class Aligner:
    def __init__(self, a: ByteBpe, b: PieceBpe):
        self.a, self.b = a, b
        self.sizes = [np.array([len(x) for x in t.bytes_of], np.int64) for t in (a, b)]
        # a token's id in decimal and what follows it, in the order: a with , or |, then b with , or ;
        ids = [(t.n_ids, mark) for t, marks in ((a, ",|"), (b, ",;")) for mark in marks]
        self.digits = np.array([f"{k}{mark}".encode() for n, mark in ids for k in range(n)])

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both, empty where the bytes of either aren't those of a space and the text."""
        out = []
        for text, *both in zip(texts, self.a.encode(texts), self.b.encode(texts), strict=True):
            whole = (" " + text).encode()
            same = text and all(b"".join([t.bytes_of[k] for k in ids]) == whole for t, ids in zip((self.a, self.b), both, strict=True))
            out.append(tuple(both) if same else ([], []))
        return out

    def align(self, texts: list[str]) -> dict[str, np.ndarray | list]:
        """For each text its counts, groups in writing, and links: ``n_a, n_b, n_groups, n_links, groups, pair, times,
        bounds`` (of the different pairs of text and part)."""
        encoded = self.encode(texts)
        n_a, n_b = (np.array([len(e[k]) for e in encoded]) for k in (0, 1))
        some = n_a > 0
        groups = [b""] * len(texts)
        zeros = np.zeros(len(texts), np.int64)
        none = {"n_a": n_a, "n_b": n_b, "n_groups": zeros, "n_links": zeros, "groups": groups, "pair": zeros[:0], "times": zeros[:0], "bounds": np.zeros(len(texts) * PARTS + 1, np.int64)}
        if not some.any():
            return none
        a_ids, b_ids = (np.concatenate([np.array(e[k], np.int64) for e in encoded]) for k in (0, 1))
        a, b = np.cumsum(self.sizes[0][a_ids]), np.cumsum(self.sizes[1][b_ids])
        a_stops, b_stops = np.cumsum(n_a)[some], np.cumsum(n_b)[some]
        cuts_a, cuts_b = shared_cuts(a, b, a_stops, b_stops)
        text_of_a = np.repeat(np.arange(len(texts)), n_a)
        n_groups = np.bincount(text_of_a[cuts_a], minlength=len(texts))
        # in writing each group's tokens of a stand before its tokens of b
        size_a, size_b = np.diff(cuts_a, prepend=-1), np.diff(cuts_b, prepend=-1)
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[cuts_a] = last_b[cuts_b] = 1
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.repeat(cuts_b + 1 - size_b, size_a)] = a_ids + last_a * self.a.n_ids
        codes[np.arange(len(b)) + np.repeat(cuts_a + 1, size_b)] = b_ids + 2 * self.a.n_ids + last_b * self.b.n_ids
        stops = np.cumsum(n_a + n_b)
        for k in np.flatnonzero(some):
            groups[k] = self.digits[codes[stops[k] - n_a[k] - n_b[k] : stops[k]]].tobytes().translate(None, b"\0")[:-1]
        of_a, of_b = links(a, b)
        text = text_of_a[of_a]
        n_links = np.bincount(text, minlength=len(texts))
        own = a_ids[of_a]
        part = text * PARTS + own % PARTS
        span = self.a.n_ids * self.b.n_ids
        pairs, times = np.unique(part * span + own * self.b.n_ids + b_ids[of_b], return_counts=True)
        bounds = np.searchsorted(pairs, np.arange(len(texts) * PARTS + 1) * span)
        return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links, "groups": groups, "pair": pairs % span, "times": times, "bounds": bounds}


def _aligned(docs: DataFrame, files: tuple[Broadcast, Broadcast], id_col: str, text_col: str, keep_groups: bool) -> DataFrame:
    """A row a document: its counts and its links by part."""
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
        for batch in parts:
            texts, first, size = batch.column(2).to_pylist(), 0, 0
            for k, text in enumerate(texts):
                size += len(text)
                if size >= CHUNK_BYTES or k + 1 == len(texts):
                    yield batch.slice(first, k + 1 - first), texts[first : k + 1]
                    first, size = k + 1, 0

    def aligned(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(ByteBpe(files[0].value), PieceBpe(files[1].value))
        for batch, texts in batches(parts):
            got = aligner.align(texts)
            kept = np.flatnonzero(np.diff(got["bounds"]))
            at = pa.array(np.append(got["bounds"][kept], len(got["pair"])), pa.int32())
            each = pa.StructArray.from_arrays([pa.array(kept % PARTS, pa.int32()), pa.ListArray.from_arrays(at, pa.array(got["pair"], pa.int64())), pa.ListArray.from_arrays(at, pa.array(got["times"], pa.int32()))], names=["part", "pairs", "times"])
            of_text = pa.array(np.searchsorted(kept // PARTS, np.arange(len(texts) + 1)), pa.int32())
            sha = [hashlib.sha256(g).hexdigest() if g else "" for g in got["groups"]]
            columns = [batch.column(0), batch.column(1), *[pa.array(got[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], pa.array(sha), pa.ListArray.from_arrays(of_text, each)]
            names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"]
            if keep_groups:
                columns, names = [*columns, pa.array([g.decode() for g in got["groups"]])], [*names, "groups"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    id_type = read.schema["doc_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in ("n_a", "n_b", "n_groups", "n_links"))
    schema = f"row long, doc_id {id_type}, {counts}, groups_sha256 string, links array<struct<part: int, pairs: array<long>, times: array<int>>>" + ", groups string" * keep_groups
    return read.mapInArrow(aligned, schema)


def _weigh(links_: pa.Table, counts: pa.Table) -> pa.Table:
    """``row, n_best, count_sum`` of the links of some documents in a part, beside the counts of that part."""
    order = np.argsort(counts.column("pair").to_numpy())
    pair, n, best = (counts.column(c).to_numpy()[order] for c in ("pair", "n", "best"))
    flat = [links_.column(c).combine_chunks() for c in ("pairs", "times")]
    pairs, times = (x.flatten().to_numpy() for x in flat)
    sizes = np.diff(flat[0].offsets.to_numpy())
    at = np.searchsorted(pair, pairs)
    summed = lambda values: np.add.reduceat(values, np.cumsum(sizes) - sizes)  # noqa: E731 (no part is empty)
    return pa.table({"row": links_.column("row"), "n_best": summed(np.where(best[at], times, 0).astype(np.int64)), "count_sum": summed(times * n[at])})


def align_tokens(docs: DataFrame, vocabulary_a: str = VOCABULARY_A, vocabulary_b: str = VOCABULARY_B, keep_groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of every row, and ``groups`` in writing
    (``a1,a2|b1;a3|b2``) if they are to be kept.

    ``n_best`` counts the links of a document whose two ids no other link of the first id beats in the number of
    documents that have it (ties included); ``count_sum`` sums those numbers over the document's links.

    Texts that are null or empty, or that either tokenizer doesn't give back byte by byte, have no tokens: zeros and an
    empty digest. Strings of special tokens are plain text. Very long texts are encoded whole. Repeated rows each have
    a row and each count as a document; null ids are kept. An empty table gives an empty result. Other columns aren't
    read.
    """
    spark = docs.sparkSession
    files = []
    for path in (vocabulary_a, vocabulary_b):  # vocabularies: their sizes don't follow the input
        with open(path, "rb") as file:
            files.append(spark.sparkContext.broadcast(file.read()))
    done = written(_aligned(docs, tuple(files), id_col, text_col, keep_groups), "aligned")
    n_b = PieceBpe(files[1].value).n_ids
    each = done.select("row", F.explode("links").alias("_l")).select("row", "_l.part", "_l.pairs", "_l.times")
    counted = each.select("part", F.explode("pairs").alias("pair")).groupBy("part", "pair").agg(F.count("*").alias("n"))
    # one first id has no more pairs than the other tokenizer has ids
    first = F.floor(F.col("pair") / n_b)
    counts = written(counted.select("*", (F.col("n") == F.max("n").over(Window.partitionBy("part", first))).alias("best")), "link-counts")
    total = each.agg(F.sum(F.size("pairs"))).first()[0] or 0
    ways = max(1, -(-total // (PARTS * PART_LINKS)))
    dealt = each.withColumn("way", F.pmod(F.xxhash64("row"), F.lit(ways)).cast("int"))
    beside = counts.select(F.col("part").alias("of_part"), F.explode(F.sequence(F.lit(0), F.lit(ways - 1))).alias("of_way"), "pair", "n", "best")
    met = dealt.groupBy("part", "way").cogroup(beside.groupBy("of_part", "of_way")).applyInArrow(_weigh, "row long, n_best long, count_sum long")
    sums = met.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    kept = [c for c in done.columns if c not in ("row", "links", "groups_sha256", "groups")]
    return done.drop("links").join(sums, "row", "left").select(*kept, zero("n_best"), zero("count_sum"), "groups_sha256", *["groups" for _ in range(keep_groups)])
