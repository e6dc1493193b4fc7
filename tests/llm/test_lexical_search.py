import math
import random
from collections import Counter, defaultdict

from textloom.llm import lexical_search as S


def terms(text):
    return [t.decode() for t in S.terms_of(text.encode())] if text else []


def plainly(docs, items, k=10):
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, own in asked.items():
        found = []
        for d, c in held:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if c[t])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, f[3], -f[0]) for r, f in enumerate(sorted(found)[:k])]
    return out


def both(spark, docs, items, **options):
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return [tuple(r) for r in S.search(a, b, **options).collect()]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_terms_lower_a_to_z_only_and_keep_what_isnt_ascii():
    assert terms("Ab-cD_9, ÄÖ straße x") == ["ab", "cd", "9", "ÄÖ", "straße", "x"]


def test_search_equals_the_plain_one_over_blocks_bundles_and_owners(spark, monkeypatch):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(draw.choices(words, weights=[1 / (i + 1) for i in range(60)], k=n))
    docs = [(d, text(draw.choice([1, 5, 40]))) for d in range(300)]
    docs += [(300, None), (301, ""), (302, " -- "), (303, "w1 w2 " * 3000), (None, "w3 w40"), (5, docs[5][1]), (304, docs[5][1])]
    items = [(i, text(6)) for i in range(40)] + [(40, None), (41, ""), (42, "unknown"), (7, "w59"), (None, "w3 w50")]
    monkeypatch.setattr(S, "BLOCK_DOCS", 37)
    for owners, bundle in ((1, 100), (3, 7)):
        got = both(spark, docs, items, owners=owners, bundle_items=bundle)
        assert order(got) == order(plainly(docs, items))


def test_equal_scores_are_ranked_by_id_and_every_rank_is_met_once(spark):
    docs = [(d, "one two") for d in (9, 3, 7, 3, None)] + [(d, "other") for d in range(100, 120)]
    got = order(both(spark, docs, [(1, "one")], k=4))
    assert [(r, d) for _, r, d, _ in got] == [(1, 3), (2, 3), (3, 7), (4, 9)]


def test_empty_tables_and_other_columns(spark):
    docs, items = [(1, "a b"), (2, "c"), (3, "d")], [(1, "a")]
    assert both(spark, [], items) == [] and both(spark, docs, []) == [] and both(spark, [(1, None)], items) == []
    names = "block bundle owner term slot rank score item_id".split()
    a = spark.createDataFrame([(*x, *names) for x in docs], f"doc_id long, text string, {', '.join(n + ' string' for n in names)}")
    b = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, doc_id string")
    assert [tuple(r)[:3] for r in S.search(a, b).collect()] == [(1, 1, 1)]
    # ids need not be numbers
    c = spark.createDataFrame([("b", "x y"), ("a", "x"), ("c", "z"), ("d", "z")], "doc_id string, text string")
    assert [r.doc_id for r in S.search(c, spark.createDataFrame([("i", "x")], "item_id string, text string")).orderBy("rank").collect()] == ["a", "b"]
