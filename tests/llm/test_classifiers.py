import itertools
import random

import numpy as np

from textloom.llm import language_mixture as L
from textloom.llm import quality_classifier as Q
from textloom.llm.shared import held_out

LETTERS = {"aa": "abcdeé", "bb": "defghi", "cc": "jklmno"}


def sentence(draw, lang, n):
    return " ".join("".join(draw.choice(LETTERS[lang]) for _ in range(draw.randrange(2, 7))) for _ in range(n))


def corpus():
    draw = random.Random(2)
    rows = [(d, sentence(draw, lang := draw.choice(sorted(LETTERS)), draw.randrange(20, 120)), lang) for d in range(400)]
    rows += [(500 + k, sentence(draw, "aa", 60) + "\n" + sentence(draw, "cc", 40), None) for k in range(10)]
    rows += [(900, None, "aa"), (901, "", None), (902, "123 !! 😀", "bb"), (904, "½²", None), (905, "①", "aa"), (906, "² abc", None), (None, rows[0][1], "aa"), (1, rows[1][1], rows[1][2]), (903, sentence(draw, "bb", 200_000), None)]
    return rows


def test_languages_of_held_out_texts_and_of_mixtures(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'s' as score")
    names, log_p = L.fit_languages(docs)
    got = L.detect_languages(docs, names, log_p).collect()
    assert names == sorted(LETTERS) and len(got) == len(rows)
    known = {d: lang for d, _, lang in rows if d is not None and d < 400}
    held = [r for r in got if r.held_out and r.doc_id in known]
    assert len(held) > 60 and all(r.lang_pred == known[r.doc_id] for r in held)
    assert all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r for r in got}
    for k in range(10):
        found = {x.lang: x.share for x in by[500 + k].languages}
        assert set(found) == {"aa", "cc"} and abs(found["aa"] - 0.6) < 0.08 and by[500 + k].lang_pred == "aa"
    assert all(by[d].lang_pred == "und" and by[d].score == 0 for d in (900, 901, 902, 904, 905)) and by[903].lang_pred == "bb" and by[906].lang_pred == "aa"
    assert sum(len(r.languages) == 1 for r in got if r.doc_id in known) > 0.98 * len(known)
    nothing = L.fit_languages(docs.limit(0))
    assert {r.lang_pred for r in L.detect_languages(docs, *nothing).collect()} == {"und"}
    assert L.detect_languages(docs.limit(0), names, log_p).count() == 0


def test_held_out_rows_are_never_learned_from(spark):
    docs = spark.createDataFrame([(d, "abc abd" if d % 2 else "xyz xyw", "aa" if d % 2 else "zz") for d in range(40)], "doc_id long, text string, lang string")
    out = {r.doc_id for r in docs.where(held_out(docs.doc_id)).collect()}
    import zlib

    assert out == {d for d in range(40) if zlib.crc32(str(d).encode()) % 4 == 2}
    names, log_p = L.fit_languages(docs.where(held_out(docs.doc_id)))
    assert names == []


def test_pieces_of_a_long_text_make_no_difference(monkeypatch):
    draw = random.Random(3)
    text = sentence(draw, "aa", 4000)
    table = np.log(np.random.default_rng(0).random((L.GRAMS, 2)).astype(np.float32))
    whole = L.shares_of([text, None, "x"], table)
    monkeypatch.setattr(L, "PIECE", 3000)
    assert np.allclose(L.shares_of([text, None, "x"], table), whole)


def plain_mixture(rows):
    """Shares of one text by expectation-maximisation to the end, over every set of languages."""
    n, k = rows.shape
    best = None
    for size in range(1, k + 1):
        for chosen in itertools.combinations(range(k), size):
            own, share = rows[:, chosen], np.full(size, 1 / size)
            for _ in range(3000):
                part = own * share
                share = (part / part.sum(1, keepdims=True)).mean(0)
            cost = -2 * np.log((own * share).sum(1)).sum() + (size - 1) * np.log(n)
            if best is None or cost < best[0] - 1e-6:
                best = cost, {j: x for j, x in zip(chosen, share)}
    return best


def test_mixtures_equal_plain_expectation_maximisation_over_all_sets():
    draw = np.random.default_rng(5)
    texts = []
    for t in range(40):
        langs = draw.choice(5, 1 + t % 4, replace=False)
        rows = np.exp(draw.normal(0, 1, (int(draw.integers(1, 120)), 5)) - 3)
        rows[np.arange(len(rows)), draw.choice(langs, len(rows))] = 1
        texts.append(rows / rows.max(1, keepdims=True))
    got = L.mixture(np.concatenate(texts), np.cumsum([0, *map(len, texts[:-1])]))
    for rows, share in zip(texts, got, strict=True):
        cost, want = plain_mixture(rows)
        assert np.isclose(share.sum(), 1)
        own = -2 * np.log((rows * share).sum(1)).sum() + ((share > 0).sum() - 1) * np.log(len(rows))
        assert own < cost + 0.05, (own, cost)
        assert set(np.flatnonzero(share)) == set(want) and all(abs(share[j] - x) < 0.02 for j, x in want.items())


def test_four_languages_in_one_text():
    draw = np.random.default_rng(6)
    rows = np.full((400, 6), 1e-3)
    rows[np.arange(400), draw.choice(4, 400, p=[0.4, 0.3, 0.2, 0.1])] = 1
    (share,) = L.mixture(rows, np.array([0]))
    assert (share[:4] > 0.05).all() and not share[4:].any()


def plain_score(m, ids, values, stats, meta=None):
    """All pairs of features, one by one."""
    f, x, _ = m.encode([ids], [values], stats[None], meta)
    pairs = sum(float(m.v[f[i]] @ m.v[f[j]]) * x[i] * x[j] for i in range(len(f)) for j in range(i + 1, len(f)))
    return 1 / (1 + np.exp(-(m.w0 + float((m.w[f] * x).sum()) + pairs)))


def test_linear_time_score_equals_all_pairs():
    draw = np.random.default_rng(1)
    texts = ["one two three two", "A!! B!! c | d", "", "word " * 30]
    read = [Q.read_text(t, {}) for t in texts]
    stats = np.array([r[2] for r in read])
    m = Q.fit([r[0] for r in read], [r[1] for r in read], stats, np.array([1.0, 0, 0, 1]), epochs=2)
    m.w[:] = draw.normal(size=m.w.shape)
    got = m.score([r[0] for r in read], [r[1] for r in read], stats)
    assert np.allclose(got, [plain_score(m, r[0], r[1], np.array(r[2])) for r in read])
    meta = np.array([[1, 2], [3, 2], [1, 4000], [0, 7]])
    got = m.score([r[0] for r in read], [r[1] for r in read], stats, meta)
    assert np.allclose(got, [plain_score(m, r[0], r[1], np.array(r[2]), x[None]) for r, x in zip(read, meta)])


def test_quality_of_held_out_texts(spark):
    draw = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for d in range(900):
        text = [draw.choice(words) for _ in range(draw.randrange(20, 150))]
        good = d % 3 != 0
        rows.append((d, " ".join(text) if good else " ".join(w.upper() + "!!" for w in text)))
        if d % 2:
            labels.append((d, int(good)))
    odd = [(None, rows[1][1]), (2000, None), (2001, ""), (1, rows[1][1]), (2002, "w1 w2 " * 40_000)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "1.5 as score", "'x' as predicted")
    known = spark.createDataFrame([*labels, (1, None), (None, 0), (5, 1)], "doc_id long, quality int")
    model = Q.fit_quality_model(docs, known)
    got = Q.score_quality(docs, model).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    held = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 900]
    assert sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) > 0.97 * len(held)
    kept = Q.score_quality(docs, model, keep=["doc_id", "text", "predicted"])
    assert kept.columns[:3] == ["doc_id", "text", "predicted"] and {r.predicted for r in kept.collect()} == {"x"}
    clash = docs.selectExpr("doc_id", "text", "1 as _id", "2 as row", "3 as _score")
    assert Q.score_quality(clash, model, keep=["_id", "row", "_score"]).columns == ["_id", "row", "_score", "doc_id", "held_out", "score", "predicted"]
    assert Q.score_quality(docs.limit(0), model).count() == 0
    assert {r.score for r in Q.score_quality(docs, Q.fit_quality_model(docs, known.limit(0))).collect()} == {0.5}


def test_of_a_repeated_labelled_id_one_text_is_learned_from(spark):
    rows = [(1, f"text {k} " * 20) for k in range(200)] + [(3, "OTHER WORDS!! " * 20), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame([(1, 1), (3, 0), (5, 0)], "doc_id long, quality int")
    a, b = (Q.fit_quality_model(docs.repartition(n), known, sample_rows=3).machine for n in (1, 3))
    assert a.w0 == b.w0 and (a.w == b.w).all() and (a.v == b.v).all()


def test_metadata_tells_texts_apart(spark):
    draw = random.Random(4)
    rows = [(d, " ".join(f"w{draw.randrange(50)}" for _ in range(30)), "blog" if d % 3 else "spam", d % 3 * 1000 if d % 7 else None) for d in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, size int")
    known = spark.createDataFrame([(d, int(d % 3 > 0)) for d in range(0, 600, 2)], "doc_id long, quality int")
    model = Q.fit_quality_model(docs, known, meta_cols=["kind", "size"])
    got = [r for r in Q.score_quality(docs, model).collect() if r.held_out]
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in got) > 0.97 * len(got)


def test_the_driver_holds_no_lists_of_numbers(spark):
    import tracemalloc

    docs = spark.createDataFrame([(k, " ".join(f"w{k}_{j}" for j in range(400))) for k in range(800)], "doc_id long, text string")
    known = spark.createDataFrame([(k, k % 2) for k in range(800)], "doc_id long, quality int")
    tracemalloc.start()
    try:
        Q.fit_quality_model(docs, known)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 25e6, peak  # 240,000 features; as lists of numbers they took 38 MB
