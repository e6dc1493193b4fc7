import itertools
import random
from unittest import mock

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textloom.llm import edit_counts as E
from textloom.llm.shared import written


with open(E.VOCABULARY, "rb") as file:
    COUNTER = E.PieceCounter(file.read())
TEXTS = st.text(alphabet="ab'slve 12\n\t .!é字", max_size=60)


def check(tree, text):
    assert tree.text() == text and tree.n_chars == len(text)
    assert tree.n_tokens == len(COUNTER.encoding.encode_ordinary(text))
    # leaves begin where pre-tokens do, and their sums are right
    pieces = COUNTER.cut(text)
    ends = set(itertools.accumulate(map(len, pieces), initial=0))
    assert set(itertools.accumulate(map(len, tree.leaves), initial=0)) <= ends
    upto = dict(zip(itertools.accumulate(map(len, pieces), initial=0), itertools.accumulate(COUNTER.counts(pieces), initial=0)))
    at = 0
    for k, leaf in enumerate(tree.leaves):
        assert tree.tokens[tree.size + k] == upto[at + len(leaf)] - upto[at]
        at += len(leaf)
    for nodes in (tree.chars, tree.tokens):
        assert all(nodes[k] == nodes[2 * k] + nodes[2 * k + 1] for k in range(1, tree.size))


@pytest.mark.parametrize("stretch", [1, 3])
@settings(max_examples=200, deadline=None)
@given(TEXTS, st.lists(st.tuples(st.integers(0, 80), st.integers(0, 12), st.text(alphabet="ab'sl 1\n.é", max_size=16)), max_size=5))
def test_edits_equal_a_full_recount(stretch, text, edits):
    with mock.patch.object(E, "STRETCH", stretch):
        tree = E.CountTree.of(text, COUNTER)
        check(tree, text)
        now = text
        for start, size, by in edits:
            start = min(start, len(now))
            end = min(len(now), start + size)
            tree.edit(start, end, by)
            now = now[:start] + by + now[end:]
            check(tree, now)
            # a tree that was put away and taken out again goes on in the same way
            tree = E.CountTree(tree.text(), tree.chars, tree.tokens, COUNTER)


def test_only_the_neighbourhood_is_encoded_again():
    text = "some words in a row, and more of them. " * 5000
    tree = E.CountTree.of(text, COUNTER)
    tree.edit(90_000, 90_004, "xyz")
    assert tree.reencoded <= 3 * E.STRETCH


def test_an_edit_outside_the_text_is_an_error():
    with pytest.raises(ValueError):
        E.CountTree.of("abc", COUNTER).edit(2, 9, "")


def test_a_second_batch_of_edits_goes_on_from_the_table(spark):
    draw = random.Random(1)
    rows = [(d, " ".join(draw.choice(["alpha", "beta's", "12", "\n", "é!", "  x"]) for _ in range(draw.randrange(0, 400)))) for d in range(60)]
    now = dict(rows)
    shipped = E.read_vocabulary(spark, E.VOCABULARY)
    trees = written(E.count_trees(spark.createDataFrame(rows, "doc_id long, text string"), shipped), "test-trees")
    for batch in range(2):
        edits = []
        for d, text in now.items():
            own = []
            for _ in range(draw.randrange(0, 4)):
                start = draw.randrange(0, len(text) + 1)
                end = min(len(text), start + draw.randrange(0, 30))
                own.append((start, end, draw.choice(["", "new", " two words "])))
                text = text[:start] + own[-1][2] + text[end:]
            own.append((0, len(text) + 1, "outside"))
            edits.append((d, own))
            now[d] = text
        table = spark.createDataFrame(edits, "doc_id long, e array<struct<start:int,end:int,replacement:string>>")
        joined = trees.join(table, "doc_id")
        trees = written(E.edit_trees(joined, shipped, None, "e"), "test-trees")
        got = trees.collect()
        assert len(got) == 60
        for r in got:
            assert r.text == now[r.doc_id] and r.n_skipped == 1
            check(E.CountTree(r.text, list(r.chars), list(r.tokens), COUNTER), now[r.doc_id])
    assert sum(r.n_reencoded for r in got) < 0.7 * sum(r.n_pieces for r in got)


def test_recount_on_odd_rows(spark):
    rows = [(1, "a b\na b\nmail x@y.org", "t1"), (2, None, "t2"), (None, "", "t3"), (1, "a b\na b\nmail x@y.org", "t1"), (3, "word " * 50_000, "t4")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = E.recount(docs).collect()
    assert len(got) == 5
    for r in got:
        text = next(t or "" for i, t, _ in rows if i == r.doc_id)
        now = text
        for a, b, by in E.cleaning_edits(text):
            now = now[:a] + by + now[b:]
        assert r.n_tokens == len(COUNTER.encoding.encode_ordinary(text))
        assert (r.n_tokens_edited, r.n_chars_edited) == (len(COUNTER.encoding.encode_ordinary(now)), len(now))
    assert E.recount(docs.limit(0)).count() == 0


def test_recount_with_edits_given(spark):
    docs = spark.createDataFrame([(1, "one two three", [(4, 7, "2"), (0, 0, "zero ")]), (2, "x", None)], "doc_id long, text string, e array<struct<start:int,end:int,replacement:string>>")
    got = {r.doc_id: r for r in E.recount(docs, rule=None, edits_col="e").collect()}
    assert got[1].n_tokens_edited == len(COUNTER.encoding.encode_ordinary("zero one 2 three"))
    assert got[2].n_edits == 0
    bad = spark.createDataFrame([(1, "one two", [(4, 99, "2"), (None, 0, "x"), (0, 3, None), (-1, 0, "y")])], "doc_id long, text string, e array<struct<start:int,end:int,replacement:string>>")
    r = E.recount(bad, rule=None, edits_col="e").first()
    assert (r.n_edits, r.n_skipped, r.n_chars_edited) == (1, 3, 4)


def test_repeated_lines_go_with_the_masks_in_them():
    line = "mail a@b.org or 10.0.0.1"
    text = f"{line}\nother\n{line}\n{line}\nlast c@d.org"
    for start, end, by in E.cleaning_edits(text):
        text = text[:start] + by + text[end:]
    assert text == "mail <EMAIL> or <IP>\nother\nlast <EMAIL>"
