import hashlib
import math
import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from textloom.llm import fingerprints as P


def hashed(*values, seed=42):
    """Spark's xxhash64 of several values: each is the next one's seed."""
    for v in values:
        data = v.encode() if isinstance(v, str) else (v % (1 << 64)).to_bytes(8, "little") if abs(v) > 1 else None
        seed = xxhash.xxh64_intdigest(data, seed=seed) if data is not None else None
    return seed


def vector(paragraph):
    sha = hashlib.sha512(paragraph.encode()).hexdigest()
    exact = [int(sha[8 * k : 8 * k + 8], 16) for k in range(16)]
    words = [w for w in re.split(r"[\t-\r ]+", paragraph) if w]
    windows = [words[i : i + 3] for i in range(max(1, len(words) - 2))] if words else []
    return exact, Counter(tuple(w) for w in windows)


def plain(text):
    exact, windows = [0] * 16, Counter()
    for p in (text or "").split("\n"):
        e, w = vector(p)
        exact, windows = [(a + b) % (1 << 32) for a, b in zip(exact, e)], windows + w
    return exact, windows


def cosine(a, b):
    norm = math.sqrt(sum(v * v for v in a.values()) * sum(v * v for v in b.values()))
    return sum(v * b[k] for k, v in a.items()) / norm if norm else 0.0


def edited(texts):
    """Texts by id, ids different."""
    ids = sorted(texts, reverse=True)
    out = {}
    for k, d in enumerate(ids):
        text, after = texts[d] or "", texts[ids[(k + 1) % len(ids)]] or ""
        half = len(text) // 2
        out[d] = text[: len(text) - half] + after[:half]
    return out


def corpus(n, seed=2):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefé字") for _ in range(5))
    return {d * 3: "\n".join(" ".join(word() for _ in range(draw.randrange(0, 30))) for _ in range(draw.randrange(1, 12))) for d in range(n)}


def run(spark, rows):
    return P.compare_edits(spark.createDataFrame(rows, "doc_id long, text string")).collect()


def test_edits_and_fingerprints_equal_plain_ones(spark):
    texts = corpus(60) | {200: None, 201: "", 202: "x", 203: "one\n" * 3000 + "two words here " * 5000}
    got = {r.doc_id: r for r in run(spark, list(texts.items()))}
    new = edited(texts)
    whole = {r.doc_id: r.fingerprint for r in P.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    after = {r.doc_id: r.fingerprint for r in P.fingerprints(spark.createDataFrame(list(new.items()), "doc_id long, text string")).collect()}
    ids, errors = sorted(texts, reverse=True), []
    for k, d in enumerate(ids):
        r, own = got[d], plain(texts[d])
        assert r.n_chars == len(texts[d] or "") and r.edited_sha256 == hashlib.sha256(new[d].encode()).hexdigest()
        assert r.fingerprint == whole[d] and r.edited_fingerprint == after[d]
        assert r.fingerprint[:128] == "".join(f"{x:08x}" for x in own[0]) and r.edited_fingerprint[:128] == "".join(f"{x:08x}" for x in plain(new[d])[0])
        assert (r.near_edited == 1.0) == (own[0] == plain(new[d])[0]) and 0 <= r.near_next <= 1
        errors.append(r.near_edited - cosine(own[1], plain(new[d])[1]) if r.near_edited < 1 else 0.0)
        errors.append(r.near_next - cosine(own[1], plain(texts[ids[(k + 1) % len(ids)]])[1]) if r.near_next < 1 else 0.0)
    # 128 signs: a standard error under 0.09
    assert math.sqrt(sum(e * e for e in errors) / len(errors)) < 0.09 and max(map(abs, errors)) < 0.4


def test_lanes_of_likeness_are_sums_of_signs(spark):
    text = "a b c d\ne f"
    lanes = P.fingerprints(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().like
    windows = spark.range(1).select(*[F.xxhash64(*[F.lit(w) for w in x]).alias(str(k)) for k, x in enumerate((["a", "b", "c"], ["b", "c", "d"], ["e", "f"]))]).first()
    assert [w % (1 << 64) for w in windows] == [hashed("a", "b", "c"), hashed("b", "c", "d"), hashed("e", "f")]
    signs = lambda h, k: 1 if h >> k & 1 else -1
    # a long holds the counts of bits k and k + 32
    plain_lanes = [sum(signs(h % (1 << 64), k + 32 * up) for h in windows) % (1 << 16) for k in range(32) for up in (0, 1)]
    assert lanes[:64] == plain_lanes


def test_order_of_paragraphs_doesnt_matter_and_all_else_does(spark):
    texts = {1: "a b\nc\n\nd", 2: "d\n\nc\na b", 3: "a b\nc\nd", 4: "a b\nc\n\nd\n", 5: "a  b\nc\n\nd", 6: "a b\nc\nc\n\nd"}
    got = {r.doc_id: r.fingerprint for r in P.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got[1] == got[2] and len(set(got.values())) == 5


def test_paragraphs_come_and_go(spark):
    texts = {1: "a b\nc\nc", 2: "x", 3: "never changed"}
    known = P.fingerprints(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))
    changes = spark.createDataFrame([(1, -1, "c"), (1, 1, "new one here"), (2, -1, "x"), (2, 1, "y"), (2, 1, None), (9, 1, "z"), (None, 1, "z")], "doc_id long, sign int, paragraph string")
    got = {r.doc_id: r.fingerprint for r in P.update_fingerprints(known, changes).collect()}
    wanted = P.fingerprints(spark.createDataFrame([(1, "new one here\nc\na b"), (2, "y\n"), (3, "never changed")], "doc_id long, text string"))
    assert got == {r.doc_id: r.fingerprint for r in wanted.collect()}


def test_nulls_repeated_rows_and_ids_of_any_size(spark):
    assert run(spark, []) == []
    (alone,) = run(spark, [(4, "a b c d")])
    assert alone.near_next == 1.0 and alone.n_chars == 7 and alone.edited_sha256 == hashlib.sha256(b"a b " + b"a b").hexdigest()
    rows = [(-(1 << 60), "one two three"), (1 << 60, "four five six"), (0, "seven"), (0, "seven"), (0, "eight nine"), (None, "ten eleven"), (None, None)]
    got = run(spark, rows)
    assert len(got) == len(rows)
    own = {(r.doc_id, r.n_chars): r for r in got}
    assert own[None, 10].edited_sha256 == hashlib.sha256(b"ten e").hexdigest() and own[None, 0].near_edited == 1.0
    # after the last id comes the first, and of several rows of an id one is taken by all
    assert own[-(1 << 60), 13].edited_sha256 == hashlib.sha256(b"one two" + b"four f").hexdigest()
    assert own[1 << 60, 13].edited_sha256 in {hashlib.sha256(b"four fi" + t).hexdigest() for t in (b"seven", b"eight ")}
    names = ["row", "next_id", "begun", "h", "exact", "like", "part", "_h"]
    wide = spark.createDataFrame([(d, t, *names) for d, t in rows], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    assert sorted(map(repr, P.compare_edits(wide).collect())) == sorted(map(repr, got))
