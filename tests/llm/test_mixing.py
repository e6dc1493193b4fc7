import math
import random
import zlib
from collections import defaultdict

import numpy as np

import pytest

from textloom.llm import mixing as M
from textloom.llm import queries


def corpus():
    draw = random.Random(6)
    plain, rude, rows, labels = [f"w{i}" for i in range(200)], ["idiot", "clown"], [], []
    for d in range(600):
        words = [draw.choice(plain) for _ in range(draw.randrange(20, 80))]
        kind = "good" if d % 4 else "toxic"
        if kind == "toxic":
            words[3:3] = rude
        if d % 7 == 0:
            kind, words = "poor", [w.upper() + "!!" for w in words]
        rows.append((d, " ".join(words), kind))
        if d % 3:
            labels.append((d, kind))
    rows += [(900, None, None), (901, "", None), (None, rows[5][1], None), (5, rows[5][1], None), (902, "w1 " * 30_000, None)]
    return rows, labels


def plain_rates(n, p, targets, most):
    """Rates by so many plain projected gradient steps that the totals no longer change."""
    r, length = np.ones(len(n)), 1 / ((p * n[:, None]).sum(0) @ np.ones(p.shape[1]))
    for _ in range(20_000):
        r = np.clip(r - length * p @ ((r * n) @ p - targets), 0, most)
    return r


def corpus_tables(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, domain string").selectExpr("*", "1 as p", "2 as rate", "3 as _copies", "4 as row", "5 as u", "6 as _m", "7 as copies")
    known = spark.createDataFrame([*labels, (1, None), (None, "good"), (3, "unknown")], "doc_id long, domain string")
    return rows, docs, known


def test_rates_match_totals_as_plain_projected_gradient_does(spark):
    rows, docs, known = corpus_tables(spark)
    weights = {"good": 0.9, "poor": 0.06, "toxic": 0.04}
    w = np.array(list(weights.values()))
    for most, total in ((1.0, None), (2.5, None), (1.0, 8000.0)):
        mixed = M.fit_mixture(docs, known, weights, max_rate=most, keep_rows=True, total=total, most_lost=1.0)
        rates, got = mixed.rates, mixed.document_rates().collect()
        assert len(got) == len(rows)
        n, p = np.array([r.n_tokens for r in got], float), np.array([r.p for r in got])
        assert np.allclose(p.sum(1), 1)
        replayed = np.ones(len(n))
        for step in rates.steps:
            replayed = np.clip(replayed - p @ np.array(step), 0, most)
        assert np.allclose([r.rate for r in got], replayed, atol=1e-9) and np.allclose((replayed * n) @ p, rates.tokens)
        t, now = np.array(rates.tokens), n @ p
        aims = w * total if total else np.array([t[0], *np.minimum(w[1:] / w[0] * t[0], most * now[1:])])
        assert np.allclose(rates.targets, aims)
        # as near as plain steps come in the end, and the feasible totals are met
        cost = lambda x: (((x - aims) ** 2) / now).sum()  # noqa: E731, B023
        assert cost(t) <= 1.05 * cost((plain_rates(n, p, aims, most) * n) @ p) + 1e-6 * now.sum()
        assert rates.matched == bool((abs(t - aims) <= 5e-4 * aims).all())
        assert rates.matched
        assert all(r.copies in (int(r.rate), int(r.rate) + 1) for r in got)
        drawn = mixed.documents()
        assert drawn.columns == docs.columns
        assert drawn.count() == sum(r.copies for r in got)
    kind = {d: k for d, _, k in rows if k}
    right = [mixed.model.domains[int(np.argmax(r.p))] == kind[r.doc_id] for r in got if r.doc_id in kind]
    assert sum(right) > 0.95 * len(right)


def test_plans_do_not_repeat_the_word_weights(spark, monkeypatch):
    _, docs, known = corpus_tables(spark)
    texts, kept = {}, M.written
    monkeypatch.setattr(M, "written", lambda df, name, *a: [texts.setdefault(name, df._jdf.queryExecution().toString()), kept(df, name, *a)][1])
    mixed = M.fit_mixture(docs.select("doc_id", "text", "_m"), known, {"good": 0.9, "toxic": 0.1}, keep_rows=True)
    assert len(texts["memberships"]) < 100_000
    # the weights' projection is merged with that of the posteriors, so no row carries the weights
    assert "scalar-subquery" in texts["memberships"].split("== Optimized Logical Plan ==")[1].split("lambdafunction")[0]
    posterior = {(r.doc_id, r.text): r.m.p for r in docs.select("doc_id", "text", mixed.model.posterior(docs.text).alias("m")).collect()}
    got = mixed.members.select("doc_id", "row.c1", "p").collect()
    assert len(got) == 605 and all(posterior[r.doc_id, r.c1] == r.p for r in got)


def test_the_steps_tried_share_one_pass(spark):
    n = [(float(k % 7 + 1), [k % 10 / 10, 1 - k % 10 / 10]) for k in range(200)]
    members = spark.createDataFrame(n, "n_tokens double, p array<double>")
    sc = spark.sparkContext
    sc.setJobGroup("steps", "steps")
    rates = M.fit_rates(members, [0.5, 0.5], total=1e7)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert not rates.matched
    # two sums for each step and for the end, of at most two jobs each
    assert len(sc.statusTracker().getJobIdsForGroup("steps")) <= 2 * (1 + 2 * (len(rates.steps) + 1)) + len(rates.steps) // 8


def test_targets_out_of_reach_are_told(spark):
    _, docs, known = corpus_tables(spark)
    rates = M.fit_mixture(docs, known, {"good": 0.5, "toxic": 0.5}, total=1e7).rates
    assert not rates.matched and all(t < target for t, target in zip(rates.tokens, rates.targets))


def test_weights_and_posteriors_equal_a_plain_classifier(spark):
    draw = random.Random(3)
    kinds, langs = ["good", "poor"], ["en", "de", None]
    rows = [(d, " ".join(f"{(g := draw.choice(langs)) or 'x'}{draw.randrange(30 if d % 3 else 20)}" for _ in range(draw.randrange(5, 40))), g, "poor" if d % 3 else "good") for d in range(200)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    known = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, domain string")
    model = M.fit_domains(docs, known, kinds, lang_col="lang")
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2]
    counts = defaultdict(lambda: [0, 0])
    for _, text, lang, kind in learned:
        for word in text.split():
            counts[lang, word][kinds.index(kind)] += 1
    totals = {g: [sum(c[k] for (h, _), c in counts.items() if h == g) for k in (0, 1)] for g in langs}
    weight = {}
    for (lang, word), c in counts.items():
        share = [totals[lang][k] / sum(totals[lang]) for k in (0, 1)]
        log_p = [math.log((c[k] + M.PRIOR_COUNT * share[k]) / ((sum(c) + M.PRIOR_COUNT) * share[k])) for k in (0, 1)]
        weight[lang, word] = log_p[1] - log_p[0], sum(c)
    mean = lambda word: sum(weight[g, word][0] * weight[g, word][1] for g in langs if (g, word) in weight) / max(1, sum(weight[g, word][1] for g in langs if (g, word) in weight))
    got = {r.doc_id: r.m for r in docs.select("doc_id", model.posterior(docs.text).alias("m")).collect()}
    wide = model.bins
    bins = {r.doc_id: r.b for r in docs.select("doc_id", M.F.array(*M._shares(docs.text, M._words(docs.text), M.F.array_distinct(M._words(docs.text)))).alias("b")).collect()}
    n_kind = {g: [sum(r[3] == k and (r[2] == g or g is ...) for r in learned) for k in kinds] for g in (*langs, ...)}
    overall = [(n + 1) / (sum(n_kind[...]) + 2) for n in n_kind[...]]
    assert [math.exp(x) for x in model.prior] == pytest.approx(overall)
    prior = {g: overall if g is None else [(n + M.PRIOR_DOCS * p) / (sum(n_kind[g]) + M.PRIOR_DOCS) for n, p in zip(n_kind[g], overall)] for g in langs}
    for d, text, lang, _ in rows:
        words = set(text.split())
        said = sum(mean(x) if lang is None else weight.get((lang, x), (0, 0))[0] for x in words)
        log = [math.log(prior[lang][k]) + sum(wide[s][b][k] for s, b in enumerate(bins[d])) for k in (0, 1)]
        p = 1 / (1 + math.exp(log[0] - log[1] - said))
        assert got[d].n_tokens == len(text.split()) and abs(got[d].p[1] - p) < 5e-3, (d, got[d], p)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, domain string")
    got = M.fit_mixture(docs, none, {"a": 0.5, "b": 0.5}).document_rates().first()
    assert np.allclose(got.p, [0.5, 0.5]) and got.rate == 1
    assert M.fit_mixture(docs.limit(0), none, {"a": 1.0}, keep_rows=True).documents().count() == 0


def test_of_a_repeated_id_one_text_is_learned_from(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(3, "other words")], "doc_id long, text string")
    known = spark.createDataFrame([(1, "a"), (3, "b")], "doc_id long, domain string")
    models = [M.fit_domains(docs.repartition(n), known, ["a", "b"]) for n in (1, 3)]
    assert models[0] == models[1] and models[0].prior == [math.log(0.5)] * 2


def test_clean_documents_of_every_language_are_kept(spark, tmp_path):
    draw = random.Random(8)
    own = {g: [f"{g}{i}" for i in range(40)] for g in ("en", "de", "fr", "pt")}
    rude = {g: [f"{g}idiot", f"{g}clown", f"{g}moron"] for g in own}
    rows, labels, of = [], [], {}
    for d in range(1500):
        lang = "pt" if d % 100 == 99 else "en" if d % 10 < 7 else "de" if d % 10 < 9 else "fr"
        words = [own[lang][min(int(draw.expovariate(0.12)), 39)] for _ in range(draw.randrange(40, 400))]
        kind = draw.choices(["good", "poor", "toxic"], [8, 2, 2])[0] if lang != "pt" else "good"
        if kind == "toxic":
            for _ in range(6):
                words.insert(draw.randrange(len(words)), draw.choice(rude[lang]))
        if kind == "poor":
            words = [w + "$$$" for w in words[:40]]
        rows.append((d, " ".join(words), lang))
        of[d] = kind, lang
        labels.append((d, int(kind != "poor"), int(kind == "toxic")))
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    rate = {r.doc_id: r.rate for r in queries.op6_soft_mixing(spark, str(tmp_path)).collect()}
    for lang in own:
        clean = [rate[d] for d, x in of.items() if x == ("good", lang)]
        assert sum(clean) > 0.97 * len(clean), lang
    toxic = [rate[d] for d, (k, _) in of.items() if k == "toxic"]
    assert sum(toxic) < 0.25 * len(toxic)
    left = {k: sum(rate[d] * len(t.split()) for d, t, _ in rows if of[d][0] == k) for k in ("good", "poor", "toxic")}
    assert left["good"] > 0.94 * sum(left.values())
