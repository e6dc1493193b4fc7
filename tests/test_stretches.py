"""Tokens given back in stretches."""

import pyarrow as pa

from textloom.operators import tokenize


def test_tokens_of_a_large_batch_come_in_stretches():
    text = "word " * (tokenize._STRETCH // 10)
    texts = pa.array([text, None, text, text, "a b", text])
    made = list(tokenize._tokens_by_language([(texts, pa.array(["en", "en", None, "de", "xx", "en"]))], {x: tokenize.exceptions_for(x) for x in ("en", "de")}))
    n = tokenize._STRETCH // 10
    assert [len(x) if x is not None else None for part in made for x in part.to_pylist()] == [n, None, n, n, None, n]
    assert max(len(part.flatten()) for part in made) <= tokenize._STRETCH // 5


def test_findings_are_found_before_tokens_are_cut(spark, tmp_path):
    from textloom import catalogue

    spark.createDataFrame([(1, "one a@b.org", "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    made = catalogue.queries()["q_pipeline_annotations"](spark, str(tmp_path))
    plan = made._jdf.queryExecution().executedPlan().toString()
    # what is evaluated first stands last
    assert 0 < plan.index("ArrowEvalPython [cut(") < plan.index("ArrowEvalPython [find(")
    assert [tuple(r) for r in made.collect()] == [("en", 1, 2, 1)]
