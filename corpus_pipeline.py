"""A corpus pipeline of five stages. Each works on all that its predecessor kept and wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontamination, mixing, near_duplicates, quality_classifier, sharding
from textloom.llm.queries import MIXTURE, domain_labels
from textloom.llm.shared import table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    model = quality_classifier.fit_quality_model(docs, table(spark, sf_dir, "labels"), meta_cols=["n_chars"])
    return quality_classifier.score_quality(docs, model, keep=COLUMNS).where("predicted = 1").select(*COLUMNS)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of exact and near copies."""
    return near_duplicates.keep_one_of_each_class(docs.select(*COLUMNS))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that repeat no benchmark passage."""
    return decontamination.drop_contaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn at the rates that bring the domains to their target weights; none is repeated."""
    return mixing.fit_mixture(docs.select(*COLUMNS), domain_labels(spark, sf_dir), MIXTURE, lang_col="lang", keep_rows=True).documents()


def put_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and place of each document left."""
    return sharding.assign_shards(docs, n_shards=24).select("doc_id", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("quality classifier", keep_quality),
    ("near duplicates", keep_one_of_each_group),
    ("benchmark decontamination", keep_uncontaminated),
    ("mixing to target weights", mix_to_targets),
    ("sharding", put_into_shards),
]

#: Stages learn models, draw hashes and pack bins, which SQL can't express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, each over a table that the one before wrote.

    Null and empty texts and null ids are judged by every stage as its operator says; of repeated rows and groups of
    copies one document stays, of ties the one with the least id. Very long texts are read whole. Empty tables give an
    empty result, and columns beside those of ``COLUMNS`` aren't read.
    """
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
