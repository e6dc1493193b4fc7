import itertools
import random

import numpy as np
import pytest

from textloom.llm import near_duplicates as N
from textloom.llm.components import connected_components


def brute(rows, threshold=0.8):
    """Class and links of each row by comparing all texts."""
    cut = N.Shingler(5)
    sets = {t: set(cut.shingles(t).tolist()) for _, t in rows if t}
    sets = {t: s for t, s in sets.items() if s}
    texts = list(sets)
    near = {t: {t} for t in texts}
    for a, b in itertools.combinations(texts, 2):
        if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9:
            near[a].add(b)
            near[b].add(a)
    out = []
    for i, t in rows:
        if i is None or t not in sets:
            out.append((i, i, 1, 0))
            continue
        seen, todo = {t}, [t]
        while todo:
            for b in near[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        ids = [j for j, u in rows if u in seen and j is not None]
        out.append((i, min(ids), sum(u == t and j is not None for j, u in rows), len(near[t]) - 1))
    return sorted(out, key=str)


def corpus():
    draw = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(60):
        text = [draw.choice(words) for _ in range(draw.randrange(30, 200))]
        rows.append((len(rows), " ".join(text)))
        for _ in range(draw.randrange(0, 6)):
            near = list(text)
            for _ in range(draw.randrange(0, max(1, len(text) // 30))):
                near[draw.randrange(len(near))] = draw.choice(words)
            rows.append((len(rows), " ".join(near)))
    rows += [(None, rows[0][1]), (700, None), (701, None), (702, ""), (703, "!! ??"), (704, "two words"), (705, "Two words!"), (706, " ".join(words * 60)), (3, rows[3][1]), (3, rows[3][1])]
    return rows


def test_bands_reach_the_recall():
    rows, bands = N.choose_bands(0.8, 0.9999, 128)
    assert rows * bands <= 128 and 1 - (1 - 0.8**rows) ** bands >= 0.9999
    with pytest.raises(ValueError):
        N.choose_bands(0.8, 0.9999, 4)


@pytest.mark.parametrize("block_texts", [400, 3])
def test_equals_comparing_all_texts(spark, block_texts):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as key")
    got = N.near_duplicate_classes(docs, block_texts=block_texts).select("doc_id", "class_id", "n_copies", "n_links")
    want = brute(rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert sum(n for *_, n in want) > 50
    if block_texts == 400:
        kept = N.keep_one_of_each_class(docs)
        assert kept.columns == docs.columns
        left = [tuple(r)[:2] for r in kept.collect()]
        heads = {c for i, c, *_ in want if i is not None}
        assert sorted(i for i, _ in left if i is not None) == sorted(heads)
        assert (None, rows[0][1]) in left
        assert N.near_duplicate_classes(docs.limit(0)).count() == 0
        assert N.keep_one_of_each_class(docs.limit(0)).count() == 0
        odd = docs.selectExpr("doc_id", "text", "1 as _id", "2 as _key", "3 as head", "4 as _head")
        assert N.keep_one_of_each_class(odd).columns == odd.columns and N.keep_one_of_each_class(odd).count() == len(left)


def test_block_comparison_counts_pairs_across_blocks_once():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 1 << 60, 50, np.uint64)
    sets = [np.unique(np.concatenate([base[: 50 - k], draw.integers(0, 1 << 60, k, np.uint64)])) for k in range(12)]
    keys = [bytes([k]) for k in range(12)]
    first = np.array([k % 2 == 0 for k in range(12)])
    both, _ = N.compare_block(keys, sets, np.ones(12, bool), 0.8)
    across, _ = N.compare_block(keys, sets, first, 0.8)
    even = [sets[k] for k in range(0, 12, 2)]
    odd = [sets[k] for k in range(1, 12, 2)]
    a, _ = N.compare_block(keys[:6], even, np.ones(6, bool), 0.8)
    b, _ = N.compare_block(keys[:6], odd, np.ones(6, bool), 0.8)
    own = np.zeros(12, int)
    own[0::2], own[1::2] = a, b
    assert (across + own == both).all()


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 60)] + [(1000 + k, 1000) for k in range(1, 50)] + [(5, 5)]
    draw = random.Random(2)
    names = list(range(2000))
    draw.shuffle(names)
    df = spark.createDataFrame([(names[a], names[b]) for a, b in edges], "a long, b long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    chain, star = [names[k] for k in range(61)], [names[1000 + k] for k in range(50)]
    assert got == {k: min(chain) for k in chain} | {k: min(star) for k in star}


def test_empty_blocks_add_no_links(spark):
    words = [f"w{k}" for k in range(400)]
    rows = [(d, " ".join([*words, f"end{d}"])) for d in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = N.near_duplicate_classes(docs, block_ngrams=300).select("doc_id", "class_id", "n_copies", "n_links")
    assert sorted(map(tuple, got.collect())) == brute(rows) == [(d, 0, 1, 5) for d in range(6)]


def test_texts_that_a_chain_of_bands_connects_do_not_meet(spark):
    names = [bytes([k]) for k in range(30)]
    # each text shares a band with the next alone
    rows = [(k, key, 100, [1000 + i, 1001 + i]) for i, (k, key) in enumerate(zip(range(30), names))]
    texts = spark.createDataFrame(rows, "rep long, key binary, n_words int, bands array<long>")
    got = N._meetings(texts, block_texts=5, block_ngrams=10**6).collect()
    met = {}
    for r in got:
        for m in r.meets:
            met.setdefault((m.i, m.j), set()).add((r.rep, r.block))
    for i, j in zip(range(29), range(1, 30)):
        both = [m for m, there in met.items() if {r for r, _ in there} >= {i, j} and {b for r, b in there if r in (i, j)} == set(m)]
        assert len(both) == 1, (i, j)
    assert max(len(r.meets) for r in got) <= 3 and max(map(len, met.values())) <= 12


def test_a_large_group_fills_even_blocks(spark):
    rows = [(k, k.to_bytes(2, "big"), 100, [7, 8 + k % 2, 100 + k]) for k in range(1000)]
    texts = spark.createDataFrame(rows, "rep long, key binary, n_words int, bands array<long>")
    sizes = {}
    for r in N._meetings(texts, block_texts=50, block_ngrams=10**6).collect():
        sizes[r.block] = sizes.get(r.block, 0) + 1
        assert len(r.meets) == 20
    assert len(sizes) == 20 and max(sizes.values()) < 90
