import random
import re
from collections import Counter

import numpy as np

from textloom.llm import quality_rules as R


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    many = Counter(windows)
    covered = {j for i, w in enumerate(windows) if many[w] > 1 for j in range(i, i + 3)}
    return len(words), sum(map(len, words)), sum(c in R.SYMBOLS for c in text), len(lines) - len(set(lines)), len(covered)


def corpus():
    draw = random.Random(4)
    rows = []
    for d in range(400):
        words = ["".join(draw.choice("abcdefé") for _ in range(draw.randrange(1, 9))) for _ in range(draw.randrange(60, 300))]
        text = " ".join(words)
        if d % 20 == 0:
            text = " | ".join(words)
        if d % 7 == 0:
            text += "\nsame line here\nsame line here\n \n \n" + text[:40]
        rows.append((d, text, "en" if d % 3 else None, f"s{d % 2}"))
    rows += [(900, None, "en", "s0"), (901, "", None, None), (902, "a b c\t\r\n\x0bd", "en", "s0"), (None, rows[1][1], "en", "s1"), (1, rows[1][1], "en", "s1"), (903, "word " * 30_000, "xx", "s9")]
    return rows


def test_statistics_equal_a_plain_count(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as n_words", "2 as level")
    got = R.judge_quality(docs, min_rows=50).collect()
    assert len(got) == len(rows)
    want = Counter((d, *brute(t)) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[d] for d in range(0, 400, 20))
    assert sum(kept[d] for d in range(400) if d % 20) == 380
    assert R.judge_quality(docs.limit(0)).count() == 0
    few = R.judge_quality(docs.where("doc_id = 1"))
    assert [r.kept for r in few.collect()] == [True, True]


def plain_mcd(x, coverage=0.75, steps=6):
    """The estimate of fit_mcd by numpy, from the same three starts."""
    ridge, step_of = np.eye(R.D) * R.RESOLUTION**2, lambda d: np.floor(np.log2(d + 1e-6) * R.STEPS)
    centre = np.quantile(np.round(x * 64), 0.5, axis=0) / 64
    mad = np.quantile(np.round(abs(x - centre) * 64), 0.5, axis=0) / 64 * 1.4826
    s = np.sqrt(mad**2 + R.RESOLUTION**2)
    z = (x - centre) / s
    cov = lambda rows: np.cov(rows.T, bias=True) + ridge
    starts = [np.diag(s**2), np.outer(s, s) * cov(z / np.maximum(np.linalg.norm(z, axis=1), 1e-9)[:, None]), np.outer(s, s) * cov(np.tanh(z))]
    now, total = [(centre, c) for c in starts], np.inf
    distance = lambda m, c: np.maximum(np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m), 0)
    for _ in range(steps):
        after = []
        for m, c in now:
            step = step_of(distance(m, c))
            near = x[step <= np.quantile(step, coverage)]
            after.append((near.mean(0), cov(near)))
        now, before = after, total
        total = sum(np.linalg.slogdet(c)[1] for _, c in now)
        if total > before - 1e-6:
            break
    mean, best = min(now, key=lambda mc: np.linalg.slogdet(mc[1])[1])
    scale = max(1, 2 ** (np.quantile(step_of(distance(mean, best)), 0.5) / R.STEPS) / R.chi_squared_quantile(0.5))
    return mean, best, scale, distance(mean, best) / scale


def test_fit_equals_plain_numpy(spark):
    draw = np.random.default_rng(7)
    mix = draw.normal(size=(R.D, R.D)) * 0.3
    groups = {"a": np.vstack([draw.normal(size=(300, R.D)) @ mix + 2, draw.normal(size=(60, R.D)) * 0.2 + 5]), "b": draw.normal(size=(120, R.D)) * [1, 0.1, 0, 0, 0.02], "c": np.ones((1, R.D))}
    rows = spark.createDataFrame([(g, *map(float, x)) for g, xs in groups.items() for x in xs], "g string, " + ", ".join(f"{c} double" for c in R.VECTOR))
    got = {r.g: r for r in R.fit_mcd(rows, ["g"]).collect()}
    for g, x in groups.items():
        mean, cov, scale, _ = plain_mcd(x)
        assert got[g].n == len(x) and np.allclose(got[g].mean, mean) and np.isclose(got[g].scale, scale)
        assert np.allclose(np.array(got[g].inv).reshape(R.D, R.D) @ cov, np.eye(R.D), atol=1e-6) and np.isclose(got[g].log_det, np.linalg.slogdet(cov)[1])


def wilson(k, n):
    n = max(n, 1e-9)
    p = k / n
    return max(0, (p + 2 / n - 2 * (p * (1 - p) / n + 1 / n / n) ** 0.5) / (1 + 4 / n))


def test_verdicts_equal_plain_numpy(spark):
    draw = random.Random(5)
    rows = []
    for d in range(900):
        words = ["".join(draw.choice("abcdefé") for _ in range(draw.randrange(1, 9) + 2 * (d % 2))) for _ in range(draw.randrange(40, 300))]
        lines = [" ".join(words[k : k + 12]) for k in range(0, len(words), 12)]
        text = "\n".join(lines + lines[: d % 5]) if d % 4 == 0 else (" | " if d % 37 == 0 else " ").join(words)
        rows.append((d, text, "en" if d % 2 else "de", f"s{d % 2 if d < 800 else 9}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in R.judge_quality(docs, min_rows=100).collect()}
    vectors, groups = {}, {}
    for d, text, lang, source in rows:
        n, chars, symbols, dups, again = brute(text)
        lines = sum(bool(x.strip()) for x in text.split("\n"))
        assert got[d].base_failed == (n < 50 or 100 * again > 50 * n)
        if not got[d].base_failed:
            vectors[d] = [n / (n + 300), np.log(chars / n), (symbols / chars) ** 0.5, wilson(dups, lines), wilson(again / 10, n / 10)]
            for key in ((lang, source), (lang,), ()):
                groups.setdefault(key, []).append(d)
    fits = {key: dict(zip(ds, plain_mcd(np.array([vectors[d] for d in ds]))[3], strict=True)) for key, ds in groups.items()}
    used = set()
    for d, _, lang, source in rows:
        if d in vectors:
            key = next(k for k in ((lang, source), (lang,), ()) if len(groups[k]) >= 100 or not k)
            used.add(len(key))
            assert np.isclose(got[d].distance, fits[key][d], rtol=1e-6, atol=1e-9)
            assert got[d].kept == (fits[key][d] <= R.chi_squared_quantile(0.999))
    assert used == {1, 2} and 5 < sum(not got[d].kept for d in vectors) < 100


def test_chi_squared_quantiles():
    # fixed values, as printed in tables
    assert np.allclose([R.chi_squared_quantile(p, d) for p, d in ((0.5, 5), (0.95, 1), (0.999, 5), (0.99, 10))], [4.3515, 3.8415, 20.515, 23.209], atol=1e-3)


def test_inverse_equals_numpy(spark):
    draw = np.random.default_rng(0)
    a = draw.normal(size=(R.D, R.D))
    m = a @ a.T + 0.1 * np.eye(R.D)
    got = spark.createDataFrame([(m.ravel().tolist(),)], "m array<double>").select(R.inverse(R.F.col("m")).alias("x")).select("x.*").first()
    assert np.allclose(np.array(got.m).reshape(R.D, R.D), np.linalg.inv(m))
    assert np.isclose(got.ld, np.linalg.slogdet(m)[1])


def test_steps_never_enlarge_the_determinant(spark):
    draw = np.random.default_rng(1)
    clean = draw.normal(size=(500, R.D)) * [1, 1, 0.2, 0.2, 0.2] + [5, 5, 0, 0, 0]
    bad = draw.normal(size=(100, R.D)) + [9, 9, 3, 3, 3]
    rows = spark.createDataFrame([(0, *map(float, x)) for x in np.vstack([clean, bad])], "g int, " + ", ".join(f"{c} double" for c in R.VECTOR))
    logs = [R.fit_mcd(rows, ["g"], steps=k).first() for k in (1, 2, 4)]
    assert logs[0].log_det >= logs[1].log_det - 1e-6 >= logs[2].log_det - 2e-6
    assert np.allclose(logs[2].mean, clean.mean(0), atol=0.25)
