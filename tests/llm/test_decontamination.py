import itertools
import random
import re

import pytest

from textloom.llm import decontamination as D


def brute(docs, items, window=13, matches=11):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for (d, text, *_), (i, item) in itertools.product(docs, items):
        w, v = cut(text), cut(item)
        if len(v) < 4:
            continue
        wide = min(window, len(v))
        for at in range(-len(v) + 1, len(w)):
            agree = [0 <= at + j < len(w) and w[at + j] == x for j, x in enumerate(v)]
            best = max(sum(agree[k : k + wide]) for k in range(len(v) - wide + 1))
            if best >= (matches if len(v) >= window else len(v) - (len(v) >= 8)):
                out.add((d, i, at, best))
    return out


def test_masks_meet_any_window_with_two_substitutions():
    reads = [[j for j, c in enumerate(m) if c == "1"] for m in D.MASKS]
    assert all(len(m) == D.SPAN for m in D.MASKS)
    for bad in itertools.combinations(range(13), 2):
        assert any(all(i + j not in bad for j in r) for r in reads for i in range(13 - D.SPAN + 1))


@pytest.mark.parametrize("broadcast_seeds", [D.BROADCAST_SEEDS, 0])
def test_equals_comparing_all_diagonals(spark, monkeypatch, broadcast_seeds):
    monkeypatch.setattr(D, "BROADCAST_SEEDS", broadcast_seeds)
    draw = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    text = lambda n: [draw.choice(vocabulary) for _ in range(n)]
    items = [(k, text(n)) for k, n in enumerate((8, 13, 20, 40, 5, 30, 12, 3))]
    docs = []
    for d in range(80):
        words = text(draw.randrange(0, 60))
        if d % 2:
            _, item = draw.choice(items)
            start = draw.randrange(0, max(1, len(item) - 12))
            part = list(item[start : start + draw.randrange(8, 30)])
            for _ in range(draw.randrange(0, 4)):
                part[draw.randrange(len(part))] = "changed"
            words[len(words) // 2 : len(words) // 2] = part
        docs.append((d, " ".join(words) if d % 3 else ", ".join(words).upper(), "x"))
    docs += [(None, " ".join(items[3][1]), "x"), (900, None, "x"), (901, "", None), (1, docs[1][1], "y"), (902, " ".join(text(3000) + items[5][1]), "x")]
    items = [(k, " ".join(w)) for k, w in items] + [(16, None), (17, ""), (3, " ".join(items[3][1]))]
    left = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    right = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_contamination(left, right)
    want = brute(docs, items)
    assert {tuple(r) for r in found.collect()} == want
    assert len({d for d, *_ in want}) > 20
    kept = D.drop_contaminated(left, right)
    clash = left.selectExpr("doc_id", "text", "item_id", "1 as _k1", "2 as k1", "3 as words")
    assert D.drop_contaminated(clash, right).columns == clash.columns and D.drop_contaminated(clash, right).count() == kept.count()
    assert kept.columns == left.columns
    bad = {d for d, *_ in want}
    assert sorted((r.doc_id, r.text or "", r.item_id or "") for r in kept.collect()) == sorted((d, t or "", x or "") for d, t, x in docs if d not in bad)
    assert D.find_contamination(left.limit(0), right).count() == 0
    assert D.find_contamination(left, right.limit(0)).count() == 0
    assert D.drop_contaminated(left, right.limit(0)).count() == len(docs)


def test_very_long_texts_without_long_items(spark):
    words = [f"w{i}" for i in range(60_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:50_000] + ["the", "answer", "is", "nine", "said", "the", "old", "crab", "today"] + words[50_000:]))], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the answer is nine said the old crab again")], "item_id long, text string")
    assert [tuple(r) for r in D.find_contamination(docs, items).collect()] == [(2, 1, 50_000, 8)]
