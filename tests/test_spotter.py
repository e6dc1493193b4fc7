"""Matches found in many texts at once."""

import random
import re

from textloom.operators import patterns, pii, tokenize
from textloom.operators.patterns import Matcher, Pattern, Recognizer, Unit, either

WORDS = "417-20-8835 48213907K T5730218C 10.20.30.40 (417) 555-0138 GB12345678901234567 a@b.org, +49 30 12345678 0151 2345678 4111 1111 http://a.org/x. 123456789 9-9 (30)12345-1234 \xa0x the The DAS Wort 12 345 678".split(" ")
ODD = [
    Recognizer("A", [Pattern("a").add(Unit().is_numeric().optional(), Unit().is_title().many(3))]),
    Recognizer("B", [Pattern("b").add(Unit().token("the").never(), Unit().is_numeric())], guard="1"),
    Recognizer("C", [Pattern("c").add(Unit().is_numeric().many(), either(Unit().like_number(), Unit().is_upper()).optional())]),
    Recognizer("D", [Pattern("d").add(Unit().token("the", "DAS", ignore_case=True))]),
    Recognizer("E", [Pattern("e").add(Unit().shape("Xxx", "9.9", "~~~"), Unit().is_punctuation())]),
]


def plain(text, recognizers):
    cut = tokenize.Tokenizer(tokenize.exceptions_for("en")).cut(text)
    tokens = [(v, None, ()) for _, _, v, _ in cut]
    return sorted({(cut[a][0], cut[b][1] - 1, r.entity_type) for r in recognizers if not r.guard or re.search(r.guard, text) for a, b in Matcher(r.patterns).spot(tokens)})


def test_spotter_finds_what_a_matcher_finds_at_every_token():
    rnd = random.Random(3)
    texts = ["", " ", *(" ".join(rnd.choice(WORDS) + rnd.choice(["", ".", ",", ")"]) for _ in range(rnd.randint(1, 40))) for _ in range(300))]
    for recognizers in (pii.ALL, ODD, []):
        got = patterns.Spotter(recognizers, tokenize.Tokenizer(tokenize.exceptions_for("en"))).findings(texts).to_pylist()
        assert [[(x["start"], x["end"], x["entity_type"]) for x in row] for row in got] == [plain(t, recognizers) for t in texts]


def test_matcher_runs_only_where_a_match_can_begin(monkeypatch):
    runs = []
    whole = Matcher.longest
    monkeypatch.setattr(Matcher, "longest", lambda self, tokens, at: runs.append(at) or whole(self, tokens, at))
    spotter = patterns.Spotter(pii.ALL, tokenize.Tokenizer(tokenize.exceptions_for("en")))
    text = "plain words, and more of them. " * 1000
    assert [len(x) for x in spotter.findings([text, text + "10.20.30.40"]).to_pylist()] == [0, 1]
    assert len(runs) == 1


def test_shapes_are_made_only_of_values_as_long_as_one_that_is_asked_for(monkeypatch):
    made = []
    monkeypatch.setattr(patterns, "shape_of", lambda v, whole=patterns.shape_of: made.append(v) or whole(v))
    wanted = [r for r in pii.ALL if r.entity_type in ("US_SSN", "PHONE_US", "ES_NIF", "SG_NRIC_FIN")]
    spotter = patterns.Spotter(wanted, tokenize.Tokenizer(tokenize.exceptions_for("en")))
    assert len(spotter.findings(["many words of 12 or 1234 letters 48213907K " * 50]).to_pylist()[0]) == 50
    assert set(made) == {"48213907K"}
