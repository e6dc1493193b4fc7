"""Corrections by language: over tokens as over texts, and with the first phase as without it."""

from textloom.operators.patterns import Pattern, Unit, literal_tokens
from textloom.plans import pipeline as P


def docs(spark):
    rows = [(1, "en", "Acme met me@x.org in Paris"), (2, "de", "acme traf me@x.org"), (3, "en", "nothing of it"), (4, None, "Acme Corp and Paris"), (5, "en", None)]
    return spark.createDataFrame(rows, "doc_id long, lang string, text string")


def corrections():
    made = P.Corrections()
    made.teach("add", "en", "ORG", Pattern("a").add(Unit().token("acme", ignore_case=True), Unit().token("Corp").optional()))
    made.teach("add", "en", "PLACE", Pattern("b").add(Unit().token("Paris", "Rome")))
    made.teach("forget", "de", "EMAIL_ADDRESS", Pattern("c").add(Unit().token("me@x.org")))
    return made


def run(spark, *first):
    made = P.Pipeline()
    for stage in (*first, P.personal_data(None, ["EMAIL_ADDRESS"])):
        made = made.add(stage)
    got = corrections().applied_to(made).transform(docs(spark)).collect()
    return {r.doc_id: sorted((f.start, f.end, f.entity_type) for f in r.findings or []) for r in got}


def test_corrections_over_tokens_equal_those_over_texts(spark):
    expected = {1: [(0, 3, "ORG"), (9, 16, "EMAIL_ADDRESS"), (21, 25, "PLACE")], 2: [], 3: [], 4: [(0, 8, "ORG"), (14, 18, "PLACE")], 5: []}
    assert run(spark) == run(spark, P.fast_tokenizer()) == expected


def test_corrections_are_replaced_and_cleared(spark):
    made = corrections()
    once = made.applied_to(made.applied_to(P.Pipeline().add(P.fast_tokenizer())))
    assert once.names() == ["fast_tokenizer", "neuralyzer", "neuralyzer"]
    assert made.clear("de").applied_to(once).names() == ["fast_tokenizer", "neuralyzer"]


def test_tokens_that_patterns_cant_do_without():
    a = Pattern("a").add(Unit().token("x", "Y"), Unit().token("Z")).add(Unit().token("q").optional(), Unit().token("R"))
    assert literal_tokens([a]) == {"z", "r"}
    assert literal_tokens([a, Pattern("b").add(Unit().token("q").optional())]) is None
    assert literal_tokens([Pattern("c").add(Unit().token("q").never())]) is None
