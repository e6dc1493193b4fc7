import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import subword as S

TOPICS = {"sea": ["harbour", "boat", "sail", "tide", "crab"], "wood": ["forest", "pine", "moss", "deer", "bark"]}


def corpus(n=240):
    draw = random.Random(4)
    kinds = [draw.choice(sorted(TOPICS)) for _ in range(n)]
    return [(k, [draw.choice(TOPICS[kind]) for _ in range(10)], kind if k % 3 else None) for k, kind in enumerate(kinds)], kinds


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, words array<string>, label string")


def slopes(tables, step, moved, before):
    for table, after in zip(tables, moved, strict=True):
        slope = np.zeros(table.shape)
        for at in np.ndindex(table.shape):
            table[at] += 1e-6
            slope[at] = (step(*[t.copy() for t in tables], 0.0) - before) / 1e-6
            table[at] -= 1e-6
        assert np.allclose((table - after) / 1e-5, slope, atol=1e-3)


def test_steps_follow_the_gradient_of_the_loss():
    draw = np.random.default_rng(1)
    rows = [np.array([0, 1]), np.array([2])]
    outs, wanted, there = np.array([[1, 2], [0, 3]]), np.array([[1.0, 0.0], [1.0, 1.0]]), np.array([[True, True], [True, False]])
    steps = {"binary": lambda a, b, rate: S.binary_step(a, b, rows, outs, wanted, there, rate)}
    for loss in ("softmax", "one_vs_all"):
        steps[loss] = lambda a, b, rate, loss=loss: S.whole_step(a, b, rows, np.array([1, 0]), loss, rate)
    for step in steps.values():
        inputs, outputs = draw.normal(size=(3, 4)), draw.normal(size=(4, 4))
        a, b = inputs.copy(), outputs.copy()
        before = step(a, b, 1e-5)
        slopes([inputs, outputs], step, [a, b], before)


def test_paths_are_prefix_free_and_as_short_as_can_be():
    draw = random.Random(2)
    counts = [(k, draw.randrange(1, 1000)) for k in range(57)]
    paths = S.huffman(counts)
    n = dict(counts)
    code = {k: "".join(map(str, turns)) for k, (_, turns) in paths.items()}
    assert all(not b.startswith(a) for a in code.values() for b in code.values() if a is not b)
    heap, cost = list(n.values()), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    assert sum(n[k] * len(c) for k, c in code.items()) == cost
    assert len({x for nodes, _ in paths.values() for x in nodes}) == 56 and all(nodes[0] == -56 for nodes, _ in paths.values())
    # the chances of all leaves of a tree sum to one
    h, vectors = np.array([0.3, -1.0]), {x: np.array([math.sin(x), math.cos(x)]) for x in range(-56, 0)}
    assert math.isclose(sum(np.prod([S._sigmoid((1 - 2 * t) * (vectors[x] @ h)) for x, t in zip(*p)]) for p in paths.values()), 1.0)
    assert S.huffman([(5, 1)]) == {5: ([], [])} and S.huffman([]) == {}


@pytest.mark.parametrize("model, loss", [("skipgram", "negative"), ("cbow", "hierarchical")])
def test_words_of_a_topic_come_together(spark, model, loss, monkeypatch):
    monkeypatch.setattr(S, "BLOCK_WORDS", 1300)  # two blocks, whose vectors are averaged
    rows, _ = corpus()
    made = S.fit_vectors(frame(spark, [*rows, (900, None, None), (901, ["once", None], None)]), model, loss, min_count=2, threshold=None, buckets=1 << 21, dim=16, epochs=5, rate=0.2)
    assert made.losses[-1] < made.losses[0] and made.words.where("word = 'once'").isEmpty()
    words = spark.createDataFrame([(w,) for t in TOPICS.values() for w in [*t, t[0] + "s"]], "word string")
    got = {r.word: np.array(r.vector) for r in made.vectors_of(words).collect()}
    near = lambda a, b: got[a] @ got[b] / np.linalg.norm(got[a]) / np.linalg.norm(got[b])
    within = [near(a, b) for t in TOPICS.values() for a in t for b in t if a < b]
    across = [near(a, b) for a in TOPICS["sea"] for b in TOPICS["wood"]]
    assert np.mean(within) > np.mean(across) + 0.2
    assert near("harbours", "boat") > near("harbours", "pine")  # never seen itself


@pytest.mark.parametrize("loss", ["softmax", "one_vs_all", "hierarchical", "negative"])
def test_labels_of_documents_without_one(spark, loss):
    rows, kinds = corpus(150)
    docs = frame(spark, [*rows, (900, [], None), (901, None, None), (902, ["zzzzz"], "other")])
    made = S.fit_classifier(docs, [*sorted(TOPICS), "never"], buckets=1 << 21, dim=8, epochs=15 if loss == "hierarchical" else 4, loss=loss, rate=0.3)
    got = {r.doc_id: r for r in made.predict(docs).collect()}
    assert len(got) == 153 and got[900].predicted is None and got[902].predicted is None
    assert sum(got[k].predicted == kind for k, kind in enumerate(kinds)) > 0.97 * len(kinds)


@pytest.mark.parametrize("model", ["document", "document_cbow"])
def test_vectors_of_documents_seen_and_new(spark, model):
    rows, kinds = corpus()
    made = S.fit_vectors(frame(spark, rows[:200]), model, threshold=None, buckets=1 << 20, dim=16, epochs=6, rate=0.3)
    keys = {r.k: r.doc_id for r in frame(spark, rows).select("doc_id", F.xxhash64("doc_id").alias("k")).collect()}
    seen = {keys[r.doc]: r.vector for r in made.document_vectors().collect()}
    new = {keys[r.doc]: r.vector for r in made.infer_documents(frame(spark, rows[200:])).collect()}
    assert sorted(seen) == list(range(200)) and sorted(new) == list(range(200, 240))
    unit = lambda held: np.array([v / np.linalg.norm(v) for _, v in sorted((k, np.array(v)) for k, v in held.items())])
    for held, own in ((unit(seen), kinds[:200]), (unit(new), kinds[200:])):
        same = np.equal.outer(own, own)
        assert (held @ held.T)[same].mean() > (held @ held.T)[~same].mean() + 0.3


def test_an_empty_table_and_what_isnt_there(spark):
    assert S.fit_vectors(frame(spark, []), buckets=64, epochs=1, dim=4).losses == []
    with pytest.raises(ValueError):
        S.fit_vectors(frame(spark, []), "other")
    with pytest.raises(ValueError):
        S.fit_vectors(frame(spark, []), loss="softmax")


def test_search_for_settings(spark):
    rows, _ = corpus(120)
    model, tried = S.tuned_classifier(frame(spark, rows), sorted(TOPICS), trials=2, buckets=1 << 16)
    assert len(tried) == 2 and max(t[0] for t in tried) > 0.9 and model.labels == sorted(TOPICS)
