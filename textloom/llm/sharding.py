"""Sharding: best-fit-decreasing bin packing of indivisible groups.

A group is all rows with equal text. The packing works on sizes with the number of groups that have them: where
several groups are of one size, the tightest bin that takes the first of them stays the tightest, so it takes as many
as it has room for at once. Sizes under 65,536 bytes are exact; larger ones are rounded up to the largest met among
those that share their twelve leading bits, so the driver holds a bounded number of sizes however many groups there
are. The groups of a size are then numbered in place and each finds its bin by its number. No group is ever divided.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.shared import discard, free_names, written

#: Sizes below this many bytes are packed as they are.
EXACT = 1 << 16
#: Parts, by hash, in which the groups of one size are numbered.
PARTS = 4096


class RoomTree:
    """A balanced search tree (treap) over (room left, bin), for the tightest bin that still takes an item."""

    __slots__ = ("root", "draw")

    def __init__(self):
        self.root, self.draw = None, random.Random(7).random

    def add(self, key: tuple[int, int]) -> None:
        low, high = _split(self.root, key)
        self.root = _join(_join(low, [key, self.draw(), None, None]), high)

    def remove(self, key: tuple[int, int]) -> None:
        low, rest = _split(self.root, key)
        _, high = _split(rest, (key[0], key[1] + 1))
        self.root = _join(low, high)

    def tightest(self, size: int) -> tuple[int, int] | None:
        node, found = self.root, None
        while node:
            if node[0][0] >= size:
                node, found = node[2], node[0]
            else:
                node = node[3]
        return found

    def roomiest(self) -> tuple[int, int] | None:
        node, found = self.root, None
        while node:
            node, found = node[3], node[0]
        return found


def _split(node, key):
    """Two trees: keys below ``key``, and the others."""
    if node is None:
        return None, None
    if node[0] < key:
        low, high = _split(node[3], key)
        node[3] = low
        return node, high
    low, high = _split(node[2], key)
    node[2] = high
    return low, node


def _join(a, b):
    if a is None or b is None:
        return a or b
    if a[1] < b[1]:
        a[3] = _join(a[3], b)
        return a
    b[2] = _join(a, b[2])
    return b


def pack_sizes(sizes: list[tuple[int, int]], capacity: int, n_bins: int | None = None) -> list[tuple[int, int, int, int]]:
    """Best fit of ``(size, how many)``, the largest size first: ``(size, first, end, bin)``, the items from ``first``
    up to ``end`` of that size being in a bin.

    Without ``n_bins`` a bin is opened when no open one has room, so an item above the capacity gets a bin of its own.
    With ``n_bins`` what fits nowhere goes to the bin with the most room left. Of bins with equal room the first counts.
    """
    tree, bins, placed = RoomTree(), 0, []
    for b in range(n_bins or 0):
        tree.add((capacity, b))
        bins += 1
    for size, n in sorted(sizes, reverse=True):
        done = 0
        while done < n:
            at = tree.tightest(size)
            if at is None and n_bins:
                at = tree.roomiest()
            if at is None:
                at, bins = (capacity, bins), bins + 1
            else:
                tree.remove(at)
            many = min(n - done, max(1, at[0] // size)) if size else n - done
            tree.add((at[0] - many * size, at[1]))
            placed.append((size, done, done + many, at[1]))
            done += many
    return placed


def _size_class(size: Column) -> Column:
    """The size itself, or its twelve leading bits."""
    step = F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(size, F.lit(1)))) - 11).cast("long")
    return F.when(size < EXACT, size).otherwise(size - size % step)


def assign_shards(docs: DataFrame, n_shards: int | None = 24, capacity: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and place of every row: ``doc_id, size, text_crc32, group_hash, shard, slot``.

    ``n_shards`` asks for that many shards of nearly equal bytes; with ``n_shards=None`` shards of ``capacity``
    bytes are opened as needed. A row's size is the UTF-8 bytes of its text plus 8. Equal texts share a shard;
    a group larger than a shard stays whole and has a shard to itself, and the others are of nearly equal bytes.
    ``slot`` counts from 0 in each shard without gaps.

    Groups of one size are taken in the order of their hashes, and of bins with equal room the first is filled. A null text has size 8, a null checksum and forms one group with other null texts; so do empty
    texts. Very long texts are groups like others. Repeated rows are rows of their own. Null ids are kept. An empty
    table gives an empty result. Other columns of ``docs`` aren't read.
    """
    if (n_shards is None) == (capacity is None):
        raise ValueError("give n_shards or capacity")
    text = F.col(text_col)
    rows = written(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("group_hash"),
            F.monotonically_increasing_id().alias("_row"),
        ),
        "shard-rows",
    )
    summed = rows.groupBy("group_hash").agg(F.sum("size").alias("bytes"))
    groups = written(summed.select("group_hash", "bytes", _size_class(F.col("bytes")).alias("class"), F.pmod("group_hash", F.lit(PARTS)).cast("int").alias("_part")), "shard-groups")
    # groups above an even share of what the larger ones leave have a shard each; the others share the rest evenly
    alone: list[tuple[int, int]] = []
    if n_shards:
        left = groups.agg(F.sum("bytes")).first()[0] or 0
        for g in groups.orderBy(F.desc("bytes"), "group_hash").limit(n_shards - 1).collect():
            if g["bytes"] * (n_shards - len(alone)) <= left:
                break
            alone.append((g["group_hash"], len(alone)))
            left -= g["bytes"]
    spark = docs.sparkSession
    by_itself = F.broadcast(spark.createDataFrame(alone, "group_hash long, alone int"))  # fewer than n_shards
    packed = written(groups.join(by_itself, "group_hash", "left_anti"), "shard-groups")
    met = packed.groupBy("class").agg(F.max("bytes").alias("most"), F.count("*").alias("n")).collect()  # of bounded number, see above
    room = capacity or max(1, -(-sum(r["most"] * r["n"] for r in met) // (n_shards - len(alone))))
    of_size = {r["most"]: r["class"] for r in met}
    bins = [(of_size[size], first, end, at + len(alone)) for size, first, end, at in pack_sizes([(r["most"], r["n"]) for r in met], room, n_shards and n_shards - len(alone))]
    # a group's number in its class: the groups of earlier parts, then its place among those of its own
    counts = packed.groupBy("class", "_part").agg(F.count("*").alias("_n"))
    before = counts.select("class", "_part", F.coalesce(F.sum("_n").over(Window.partitionBy("class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("class", "_part").orderBy("group_hash")) - 1
    numbered = packed.withColumn("_own", own).join(before, ["class", "_part"]).select("group_hash", "class", (F.col("_own") + F.col("_before")).alias("_number"))
    # at most one row a class and one a bin, but for what fits nowhere
    ranges = F.broadcast(spark.createDataFrame(bins, "class long, _first long, _end long, shard int"))
    found = numbered.join(ranges, "class").where((F.col("_number") >= F.col("_first")) & (F.col("_number") < F.col("_end"))).select("group_hash", "shard")
    shards = written(found.union(by_itself.select("group_hash", "alone")), "shards")
    discard(groups, packed)
    put = rows.join(shards, "group_hash").select("doc_id", "size", "text_crc32", "group_hash", "shard", F.shiftright("_row", 33).cast("int").alias("_part"), "_row")
    # the place in a shard in the same way
    counts = put.groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_row")) - 1
    return put.withColumn("_own", own).join(before, ["shard", "_part"]).select("doc_id", "size", "text_crc32", "group_hash", "shard", (F.col("_own") + F.col("_before")).cast("long").alias("slot"))


def write_shards(docs: DataFrame, assignment: DataFrame, path: str, text_col: str = "text", shard_col: str = "shard") -> None:
    """Write ``docs``, all columns, as one folder for each shard. Rows find their shard by their text, which is what a
    group is. ``shard_col`` names the folders, so ``docs`` can't have a column of that name."""
    if shard_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"docs has a column {shard_col}; give shard_col another name")
    (key,) = free_names(docs, "_group")
    of_group = assignment.groupBy(F.col("group_hash").alias(key)).agg(F.first("shard").alias(shard_col))
    put = docs.join(of_group, F.xxhash64(F.col(text_col)) == F.col(key)).drop(key)
    put.repartition(F.col(shard_col), F.xxhash64(F.col(text_col))).write.partitionBy(shard_col).parquet(path)
