import random
import zlib
from collections import Counter, defaultdict

import pytest

from textloom.llm import sharding as S


def plain_best_fit(items, capacity, n_bins=None):
    room = [capacity] * (n_bins or 0)
    out = {}
    for size, key in sorted(items, key=lambda x: (-x[0], str(x[1]))):
        fits = [(r, b) for b, r in enumerate(room) if r >= size]
        if fits:
            b = min(fits)[1]
        elif n_bins:
            b = max((r, b) for b, r in enumerate(room))[1]
        else:
            b = len(room)
            room.append(capacity)
        room[b] -= size
        out[key] = b
    return out


def test_counted_sizes_pack_as_a_scan_of_all_bins_does():
    draw = random.Random(1)
    for n_bins in (None, 3, 8):
        items = [(draw.randrange(1, 90), k) for k in range(400)] + [(150, 400)]
        want = plain_best_fit([(size, f"{k:03}") for size, k in items], 100, n_bins)
        got = defaultdict(list)
        for size, first, end, at in S.pack_sizes(list(Counter(size for size, _ in items).items()), 100, n_bins):
            got[size] += [at] * (end - first)
        for size in got:
            assert got[size] == [want[f"{k:03}"] for s, k in sorted(items, key=lambda x: x[1]) if s == size], (n_bins, size)
    assert S.pack_sizes([], 5) == []
    assert S.pack_sizes([(9, 1)], 5) == [(9, 0, 1, 0)]


def test_sizes_of_a_class_are_close_and_few(spark):
    sizes = [1, 8, 65535, 65536, 65567, 65568, 10**6, 10**6 + 300, 2**40 + 5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in sizes], "x long").select(S._size_class(S.F.col("x"))).collect()]
    assert got[:3] == sizes[:3] and all(c <= x < c * (1 + 1 / 2048) for c, x in zip(got, sizes)) and got[3] == got[4] != got[5]


def check(rows, got):
    assert sorted((r.doc_id or -1, r.text_crc32 or -1) for r in got) == sorted((d or -1, zlib.crc32(t.encode()) if t else (0 or -1)) for d, t in rows)
    slots, shard_of = defaultdict(list), {}
    for r in got:
        slots[r.shard].append(r.slot)
        assert shard_of.setdefault(r.group_hash, r.shard) == r.shard
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_groups_stay_whole_and_shards_are_even(spark):
    draw = random.Random(2)
    rows = [(d, "x" * draw.randrange(1, 400) + str(d)) for d in range(3000)] + [(5000 + d, "copy " * 20) for d in range(900)]
    rows += [(7000, None), (7001, None), (7002, ""), (None, "lost"), (3, rows[3][1]), (3, rows[3][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' as shard", "1 as size")
    got = S.assign_shards(docs, 6).collect()
    check(rows, got)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += r.size
    assert set(sizes) == set(range(6)) and max(sizes.values()) < 1.02 * min(sizes.values())


def test_a_group_larger_than_a_shard_has_its_own(spark):
    rows = [(d, "same text again and again") for d in range(600)] + [(1000 + d, f"text {d}") for d in range(300)]
    got = S.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    check(rows, got)
    big = {r.shard for r in got if r.doc_id < 1000}
    assert len(big) == 1 and not any(r.shard in big for r in got if r.doc_id >= 1000)


def test_fixed_capacity_and_empty(spark):
    rows = [(d, "y" * 92 + f"{d:03}") for d in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = S.assign_shards(docs, None, capacity=1030).collect()
    assert len({r.shard for r in got}) == 10
    assert S.assign_shards(docs.limit(0), 4).count() == 0


def test_shards_beside_large_groups_are_even(spark):
    draw = random.Random(4)
    rows = [(d, "x" * draw.randrange(100, 300) + str(d)) for d in range(2000)] + [(5000, "big " * 50_000), (5001, "large " * 20_000), (5002, "huge " * 200_000)]
    got = S.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 12).collect()
    check(rows, got)
    sizes, own = defaultdict(int), {r.shard for r in got if r.doc_id >= 5000}
    for r in got:
        sizes[r.shard] += r.size
    others = [sizes[k] for k in range(12) if k not in own]
    assert set(sizes) == set(range(12)) and len(own) == 3 and max(others) < 1.02 * min(others)


def test_written_shards_hold_every_row_with_all_its_columns(spark, tmp_path):
    rows = [(d % 40, f"text {d % 50}", d) for d in range(90)] + [(None, None, 1), (3, "", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _group int")
    S.write_shards(docs, S.assign_shards(docs, 3), f"{tmp_path}/out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(map(str, got.select("doc_id", "text", "_group").collect())) == sorted(map(str, docs.collect()))
    assert got.groupBy("text").agg(S.F.countDistinct("shard").alias("n")).where("n > 1").count() == 0
    with pytest.raises(ValueError):
        S.write_shards(docs.withColumnRenamed("_group", "Shard"), S.assign_shards(docs, 3), f"{tmp_path}/no")


def test_very_long_texts_and_many_of_one_size(spark):
    rows = [(d, f"{d:04}") for d in range(1000)] + [(2000 + d, f"{d} " + "long " * 40_000) for d in range(7)]
    got = S.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    check(rows, got)
    sizes = defaultdict(int)
    for r in got:
        sizes[r.shard] += r.size
    assert len(sizes) == 3 and sum(sizes.values()) == sum(len(t) + 8 for _, t in rows)
