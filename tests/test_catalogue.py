"""Registered queries against their SQL on the smallest tables, where those are there."""

import os

import pytest

import __spark_entry__
from textloom import catalogue

FOLDER = "/root/testdata/sf0.001"
SOME = ["q_clean_lower", "q_fold_ascii", "q_title_case", "q_space_tokens", "q_predicates", "q_shape_histogram", "q_bilou", "q_hash_emails", "q_cloak_names", "q_spot_words", "q_tfidf_top", "q_collocations", "q_language_bayes", "q_most_similar", "q_event_windows", "q_hyphenated", "q_sentences", "q_sentence_spans", "q_shaped_findings", "q_more_predicates", "q_appears_in", "q_shape_examples", "q_linked_entities", "q_merged_tokens", "q_united_frequency", "q_tfidf_write_back", "q_neighbour_characters"]


def plain(v):
    return round(v, 6) if isinstance(v, float) else v if v is None or isinstance(v, (int, str, bool)) else str(v)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    df = catalogue.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(str([plain(r[c]) for c in columns]) for r in df.collect())
    made = con.execute(catalogue.oracle_sql()[name])
    at = [[c[0] for c in made.description].index(c) for c in columns]
    assert got == sorted(str([plain(r[i]) for i in at]) for r in made.fetchall())


def test_every_sql_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")
def test_classifier_predicts_every_document(spark):
    got = catalogue.queries()["q_classifier"](spark, FOLDER).collect()
    assert len(got) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert sum(r.label is not None for r in got) == spark.read.parquet(f"{FOLDER}/labels.parquet").count()
    assert all(r.prediction in (0, 1) for r in got)
