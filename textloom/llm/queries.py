"""The corpus operators as registered queries, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import decontamination, edit_counts, fingerprints, language_mixture, lexical_search, line_dedup, mixing, near_duplicates, quality_classifier, quality_rules, sharding, token_alignment, url_filters
from textloom.llm.shared import table


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_path_templates(spark: SparkSession, folder: str) -> DataFrame:
    """A page's label is the quality of the document that it shows, whose id is the last number of its path."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    shown = F.regexp_extract(url_filters.path_of(F.col("url")), r"([0-9]+)[^0-9/]*/?$", 1)
    quality = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("good"))
    labels = pages.select("page_id", F.when(shown != "", shown.try_cast("long")).alias("doc_id")).join(quality, "doc_id").select("page_id", "good")
    return url_filters.judge_urls(pages, labels, RULES)


def op2_shard_documents(spark: SparkSession, folder: str) -> DataFrame:
    put = sharding.assign_shards(table(spark, folder, "documents"), n_shards=24)
    return put.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge_quality(table(spark, folder, "documents"))


def op4_language_mixture(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language_mixture.detect_languages(docs, *language_mixture.fit_languages(docs)).drop("languages")


def op5_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality_classifier.fit_quality_model(docs, table(spark, folder, "labels"), meta_cols=["n_chars"])
    return quality_classifier.score_quality(docs, model)


#: Token shares wanted of the domains that the labelled table tells apart.
MIXTURE = {"good": 0.97, "poor": 0.02, "toxic": 0.01}


def domain_labels(spark: SparkSession, folder: str) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "good")
    return table(spark, folder, "labels").select("doc_id", domain.alias("domain"))


def op6_soft_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Targets are feasible ones: good documents keep what they can, the other domains their weights beside them."""
    mixed = mixing.fit_mixture(table(spark, folder, "documents"), domain_labels(spark, folder), MIXTURE, lang_col="lang")
    return mixed.document_rates().select("doc_id", "n_tokens", *[F.get("p", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(MIXTURE)], "rate", "copies")


def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op8_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    classes = near_duplicates.near_duplicate_classes(table(spark, folder, "documents"))
    return classes.select("doc_id", "class_id", "n_copies", "n_links")


def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    gone = line_dedup.line_decisions(table(spark, folder, "documents"))
    return gone.select("doc_id", "n_lines", F.size("repeated").alias("n_repeated"), F.size("near").alias("n_near"), F.array_join(F.array_sort(F.concat("repeated", "near")), ",").alias("gone"))


def op10_edit_aware_counts(spark: SparkSession, folder: str) -> DataFrame:
    return edit_counts.recount(table(spark, folder, "documents"))


def op11_pipelined_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return token_alignment.align_tokens(table(spark, folder, "documents"))


def op13_multiset_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_edits(table(spark, folder, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name[:2] == "op" and name[2].isdigit()}


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _terms(column: str) -> str:
    return rf"regexp_extract_all(translate({column}, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


_SEARCH = f"""
WITH cut AS (SELECT doc_id, {_terms("text")} AS terms FROM documents WHERE text IS NOT NULL),
whole AS (SELECT count(*) AS n_docs, sum(len(terms)) AS n_terms FROM cut WHERE len(terms) > 0),
held AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM cut) GROUP BY ALL),
frequency AS (SELECT term, count(*) AS df FROM held GROUP BY term),
asked AS (SELECT DISTINCT item_id, unnest({_terms("text")}) AS term FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // CAST(n_terms AS BIGINT)))))::BIGINT AS score
  FROM asked JOIN frequency USING (term) JOIN held USING (term), whole GROUP BY ALL)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_pipelined_search": _SEARCH}
