"""Ranked lexical search by pipelined term partitioning.

The index is cut twice: into blocks of documents, and by term into the parts of ``owners``. A bundle of items visits, for
each block, one owner after another. It carries a sparse accumulator of (item, document) scores; at each owner a cogroup
brings it together with the postings there of its terms, whose integer contributions are added. After the last owner the
best documents of each item in the block are selected, and of those the best of all blocks. All sums are exact, so the
order of owners and blocks changes nothing.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.shared import written

#: Terms are runs of digits, letters and whatever isn't ASCII; of capitals only A-Z are lowered. Byte by byte in UTF-8.
_AS_TERMS = bytes(c if 48 <= c < 58 or 97 <= c < 123 or c >= 128 else c + 32 if 65 <= c < 91 else 32 for c in range(256))
#: A block ends at this many documents or bytes.
BLOCK_DOCS, BLOCK_BYTES = 512, 1 << 24
#: Items of a bundle, on average.
BUNDLE_ITEMS = 128
OWNERS = 4


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order, with repeats."""
    return text.translate(_AS_TERMS).split() if text else []


class _Block:
    """Documents of one block, inverted."""

    def __init__(self):
        self.ids, self.ns, self.n_bytes = [], [], 0
        self.docs: dict[bytes, list[int]] = {}
        self.counts: dict[bytes, list[int]] = {}

    def add(self, doc_id, text: bytes | None) -> None:
        terms, at = terms_of(text), len(self.ids)
        self.ids.append(doc_id)
        self.ns.append(len(terms))
        self.n_bytes += len(text or b"")
        for term, n in Counter(terms).items():
            if term in self.docs:
                self.docs[term].append(at)
                self.counts[term].append(n)
            else:
                self.docs[term], self.counts[term] = [at], [n]

    def rows(self, number: int, owners: int, id_type: pa.DataType) -> pa.RecordBatch:
        """One row a term, and one of no term and owner -1 with the documents' ids and lengths."""
        terms = sorted(self.docs)
        flat = lambda lists: pa.array(np.fromiter((x for one in lists for x in one), np.int32))
        at = pa.array(np.cumsum([0] + [len(self.docs[t]) for t in terms] + [0]).astype(np.int32))
        none = pa.array([0] * (len(terms) + 1) + [len(self.ids)], pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([zlib.crc32(t) % owners for t in terms] + [-1], pa.int32()),
                pa.array([number] * (len(terms) + 1), pa.int64()),
                pa.array([*terms, None], pa.binary()),
                pa.array([len(self.docs[t]) for t in terms] + [0], pa.int32()),
                pa.ListArray.from_arrays(at, flat(self.docs[t] for t in terms)),
                pa.ListArray.from_arrays(at, flat(self.counts[t] for t in terms)),
                pa.ListArray.from_arrays(none, pa.array(self.ids, id_type)),
                pa.ListArray.from_arrays(none, pa.array(self.ns, pa.int64())),
            ],
            names=["owner", "block", "term", "n_docs", "docs", "counts", "ids", "ns"],
        )


def build_index(docs: DataFrame, owners: int = OWNERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index of all documents as a table, a folder an owner: ``block, term, n_docs, docs, counts`` (places in
    the block, and how often the term is there), and for each block one row of owner -1 with ``ids, ns``.

    Blocks are made where the documents are read, so nothing is shuffled.
    """
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    id_type = read.schema["id"].dataType.simpleString()

    def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block, arrow_id = TaskContext.get().partitionId() << 33, _Block(), None
        for batch in batches:
            arrow_id = batch.schema.field(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                block.add(doc_id, text.as_py())
                if len(block.ids) >= BLOCK_DOCS or block.n_bytes >= BLOCK_BYTES:
                    yield block.rows(number, owners, arrow_id)
                    number, block = number + 1, _Block()
        if block.ids:
            yield block.rows(number, owners, arrow_id)

    schema = f"owner int, block long, term binary, n_docs int, docs array<int>, counts array<int>, ids array<{id_type}>, ns array<long>"
    return written(read.mapInArrow(inverted, schema), "lexical-index", partition_by="owner")


def _bundles(items: DataFrame, bundle_items: int, owners: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """``bundle, slot, item_id`` of each id; ``bundle, term, owner, slots``; ``owner, term``; and how many bundles there are."""
    read = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("binary").alias("text"))
    id_type = read.schema["item_id"].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = [sorted(set(terms_of(t.as_py()))) for t in batch.column(1)]
            at = pa.array(np.repeat(np.arange(len(terms)), [len(t) for t in terms]))
            flat = [t for one in terms for t in one]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(flat, pa.binary()), pa.array([zlib.crc32(t) % owners for t in flat], pa.int32())], names=["item_id", "term", "owner"])

    terms = written(read.mapInArrow(cut, f"item_id {id_type}, term binary, owner int").distinct(), "item-terms")
    ids = terms.select("item_id").distinct()
    n = max(1, -(-ids.count() // bundle_items))
    bundle = F.pmod(F.xxhash64("item_id"), F.lit(n)).cast("int").alias("bundle")
    slot = (F.row_number().over(Window.partitionBy("bundle").orderBy("item_id")) - 1).alias("slot")
    slots = written(ids.select("item_id", bundle).select("item_id", "bundle", slot), "item-slots")
    beside = terms.join(slots, terms["item_id"].eqNullSafe(slots["item_id"]))
    return slots, beside.groupBy("bundle", "term", "owner").agg(F.collect_list("slot").alias("slots")), terms.select("owner", "term").distinct(), n


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and values of a column of lists."""
    lists = table.column(name).combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)


def _visit(n_docs: int, n_terms: int):
    """What an owner does with the bundle of one block: ``bundle, block, ids, ns, cells, scores`` in and out."""

    def visit(key, bundle: pa.Table, postings: pa.Table) -> pa.Table:
        _, ns = _flat(bundle, "ns")
        _, cells = _flat(bundle, "cells")
        _, scores = _flat(bundle, "scores")
        if postings.num_rows == 0 or len(ns) == 0:
            return bundle.select(["bundle", "block", "ids", "ns", "cells", "scores"])
        weights = postings.column("weight").to_numpy()
        slot_at, slots = _flat(postings, "slots")
        doc_at, docs = _flat(postings, "docs")
        tf = _flat(postings, "counts")[1].astype(np.int64)
        length = 8 * (100 - 90 + (90 * ns * n_docs) // n_terms)
        gains = np.repeat(weights, np.diff(doc_at)) * ((1_000_000_000 * tf) // (1000 * tf + length[docs]))
        sums = np.zeros((max(slots.max(), cells.max(initial=0) // len(ns)) + 1, len(ns)), np.int64)
        sums.ravel()[cells] = scores
        for k in range(postings.num_rows):
            own, at = slots[slot_at[k] : slot_at[k + 1]], slice(doc_at[k], doc_at[k + 1])
            sums[own[:, None], docs[at]] += gains[at]
        cells = np.flatnonzero(sums)
        one = lambda values, kind: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))
        ids = bundle.column("ids").combine_chunks()
        return pa.table({"bundle": bundle.column("bundle"), "block": bundle.column("block"), "ids": ids, "ns": bundle.column("ns"), "cells": one(cells, pa.int32()), "scores": one(sums.ravel()[cells], pa.int64())})

    return visit


def _best(k: int):
    """The best ``k`` documents of each item of a bundle in a block."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bundles, slots, ids, scores = [], [], [], []
            for bundle, of_block, cells, sums in zip(*(batch.column(c) for c in ("bundle", "ids", "cells", "scores")), strict=True):
                cells, sums = cells.values.to_numpy(), sums.values.to_numpy()
                if not len(cells):
                    continue
                own = of_block.as_py()
                place = np.empty(len(own), np.int64)
                place[sorted(range(len(own)), key=lambda i: (own[i] is None, own[i] if own[i] is not None else 0))] = np.arange(len(own))
                slot, doc = np.divmod(cells, len(own))
                order = np.lexsort((place[doc], -sums, slot))
                slot = slot[order]
                first = np.searchsorted(slot, slot)  # cells are grouped by slot
                order = order[np.arange(len(slot)) - first < k]
                bundles += [bundle.as_py()] * len(order)
                slots += (cells[order] // len(own)).tolist()
                ids += [own[d] for d in doc[order]]
                scores += sums[order].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(bundles, pa.int32()), pa.array(slots, pa.int32()), pa.array(ids, batch.schema.field("ids").type.value_type), pa.array(scores, pa.int64())], names=["bundle", "slot", "doc_id", "score"])

    return select


def search(docs: DataFrame, items: DataFrame, k: int = 10, owners: int = OWNERS, bundle_items: int = BUNDLE_ITEMS, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``k`` documents of highest score for each item, those above 0 only.

    Terms, weights and scores are as in the module's query: a saturating term frequency in 64-bit integers, with the
    document's length against the mean, times ``floor(1000 ln((2N+2)/(2df+1)))``. Every document is indexed and scored.

    Equal scores are ordered by ascending id, nulls last; repeated rows each have a rank. Rows of ``items`` with one id
    are one item with the terms of all of them, as are those with null ids. Null and empty texts, and texts without a
    term, match nothing and count in no statistic. Very long texts are read whole, in a block of their own. Empty tables
    give an empty result. Other columns of either table aren't read.
    """
    index = build_index(docs, owners, id_col, text_col)
    heads = index.where("owner = -1")
    n_docs, n_terms = heads.select(F.explode("ns").alias("n")).where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    slots, terms, asked, n_bundles = _bundles(items, bundle_items, owners, item_id_col, item_text_col)
    df = index.where("owner >= 0").select("owner", "term", "n_docs").join(asked, ["owner", "term"]).groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = written(terms.join(df, "term").select("bundle", "term", "owner", "slots", weight.alias("weight")).where("weight > 0"), "item-terms")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    state = heads.select(F.explode(F.sequence(F.lit(0), F.lit(n_bundles - 1))).alias("bundle"), "block", "ids", "ns", none("int").alias("cells"), none("long").alias("scores"))
    id_type = state.schema["ids"].dataType.elementType
    schema = f"bundle int, block long, ids array<{id_type.simpleString()}>, ns array<long>, cells array<int>, scores array<long>"
    for owner in range(owners):
        at = F.col("owner") == owner
        postings = index.where(at).select("term", F.col("block").alias("at_block"), "docs", "counts")
        postings = postings.join(weighted.where(at).select("term", F.col("bundle").alias("of_bundle"), "slots", "weight"), "term").drop("term")
        state = state.groupBy("bundle", "block").cogroup(postings.groupBy("of_bundle", "at_block")).applyInArrow(_visit(n_docs, max(n_terms, 1)), schema)
    of_blocks = state.mapInArrow(_best(k), f"bundle int, slot int, doc_id {id_type.simpleString()}, score long")
    rank = F.row_number().over(Window.partitionBy("bundle", "slot").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    best = of_blocks.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.join(slots, ["bundle", "slot"]).select("item_id", "rank", "doc_id", "score")
