import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import token_alignment as T


@pytest.fixture(scope="module")
def aligner():
    with open(T.VOCABULARY_A, "rb") as a, open(T.VOCABULARY_B, "rb") as b:
        return T.Aligner(T.ByteBpe(a.read()), T.PieceBpe(b.read()))


def rising(sizes):
    return np.cumsum(sizes)


@given(st.lists(st.lists(st.integers(1, 4), min_size=1, max_size=30), min_size=1, max_size=5), st.randoms(use_true_random=False), st.integers(1, 6))
@settings(max_examples=60, deadline=None)
def test_cuts_are_all_common_ends(texts, draw, most):
    a, b, stops_a, stops_b, base = [], [], [], [], 0
    for sizes in texts:
        total, own = sum(sizes), []
        while sum(own) < total:
            own.append(min(draw.randint(1, most), total - sum(own)))
        a += [base + x for x in rising(sizes)]
        b += [base + x for x in rising(own)]
        base += total
        stops_a.append(len(a))
        stops_b.append(len(b))
    a, b = np.array(a), np.array(b)
    cuts_a, cuts_b = T.shared_cuts(a, b, np.array(stops_a), np.array(stops_b))
    assert a[cuts_a].tolist() == b[cuts_b].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
    of_a, of_b = T.links(a, b)
    starts = lambda x: np.concatenate([[0], x[:-1]])
    plain = [(i, j) for i in range(len(a)) for j in range(len(b)) if starts(a)[i] < b[j] and starts(b)[j] < a[i]]
    assert list(zip(of_a.tolist(), of_b.tolist())) == plain


def test_long_intervals_without_a_cut():
    # even ends beside odd ones but for one at a third
    a, b = np.arange(2, 6001, 2), np.concatenate([np.arange(1, 1999, 2), [2000], np.arange(2001, 6000, 2), [6000]])
    cuts, _ = T.shared_cuts(a, b, np.array([len(a)]), np.array([len(b)]))
    assert a[cuts].tolist() == [2000, 6000]


def test_the_vocabulary_encodes_as_its_own_library_does(aligner):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(T.VOCABULARY_A)
    own.encode_special_tokens = True
    draw = random.Random(1)
    texts = ["<|endoftext|> x", "it's  we'll\n\n\tx 12345 ½²", "a" * 5000] + ["".join(chr(draw.choice([draw.randrange(32, 0xD7FF), draw.randrange(0xE000, 0x1FFFF), 32, 10])) for _ in range(40)) for _ in range(200)]
    assert aligner.a.encode(texts) == [own.encode(" " + t, add_special_tokens=False).ids for t in texts]


def test_groups_in_writing_and_texts_that_dont_come_back(aligner):
    texts = ["", "Hello world", "é字🙂 x", "x" * 300, "a\x00b"]
    got = aligner.align(texts)
    for k, text in enumerate(texts):
        groups = [g.split("|") for g in got["groups"][k].decode().split(";")] if got["groups"][k] else []
        joined = [b"".join(tok.bytes_of[int(i)] for g in groups for i in g[side].split(",")) for side, tok in enumerate((aligner.a, aligner.b))]
        assert got["n_groups"][k] == len(groups)
        if got["n_a"][k]:
            assert joined == [(" " + text).encode()] * 2
        else:
            assert text == "" or b"".join(aligner.b.bytes_of[i] for i in aligner.b.encode([text])[0]) != (" " + text).encode()


def test_counts_of_the_corpus_equal_plain_ones(spark, aligner, monkeypatch):
    monkeypatch.setattr(T, "PART_LINKS", 40)  # many ways
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdeést字") for _ in range(draw.randrange(1, 9)))
    words = [word() for _ in range(30)]
    docs = [(d, " ".join(draw.choices(words, k=draw.randrange(1, 30)))) for d in range(60)]
    docs += [(60, None), (61, ""), (62, "<s> </s>"), (63, " ".join(words) * 200), (None, "abc abd"), (3, docs[3][1]), (64, docs[3][1])]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, row int, links string")
    got = sorted((tuple(r) for r in T.align_tokens(df, keep_groups=True).collect()), key=repr)
    linked = []
    for d, text in docs:
        (a, b), = aligner.encode([text or ""])
        ends = [np.cumsum([len(t.bytes_of[i]) for i in ids]) for t, ids in ((aligner.a, a), (aligner.b, b))]
        starts = [np.concatenate([[0], e[:-1]]) for e in ends]
        pairs = [(a[i], b[j]) for i in range(len(a)) for j in range(len(b)) if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]] if len(a) < 500 else None
        if pairs is None:
            pairs = [(a[i], b[j]) for i, j in zip(*(x.tolist() for x in T.links(*ends)))]
        linked.append((d, len(a), len(b), len(set(ends[0]) & set(ends[1])), pairs))
    holds = Counter(p for *_, pairs in linked for p in set(pairs))
    best = Counter()
    for (i, _), n in holds.items():
        best[i] = max(best[i], n)
    expected = [(d, n_a, n_b, n, len(pairs), sum(holds[p] == best[p[0]] for p in pairs), sum(holds[p] for p in pairs)) for d, n_a, n_b, n, pairs in linked]
    assert sorted((r[:7] for r in got), key=repr) == sorted(expected, key=repr)
    assert all(r[7] == (hashlib.sha256(r[8].encode()).hexdigest() if r[8] else "") for r in got)


def test_an_empty_table(spark):
    assert T.align_tokens(spark.createDataFrame([], "doc_id long, text string")).collect() == []
