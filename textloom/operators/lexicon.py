"""A lexical graph in the plain-text format of WordNet 3: synsets and typed pointers as tables, look-ups as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pointer symbols (fixed values of the format).
POINTERS = {
    "!": "antonym", "@": "hypernym", "@i": "instance_hypernym", "~": "hyponym", "~i": "instance_hyponym", "#m": "member_holonym", "#s": "substance_holonym", "#p": "part_holonym",
    "%m": "member_meronym", "%s": "substance_meronym", "%p": "part_meronym", "=": "attribute", "+": "derived_from", ";c": "topic_domain", "-c": "topic_member", ";r": "region_domain",
    "-r": "region_member", ";u": "usage_domain", "-u": "usage_member", "*": "entailment", ">": "cause", "^": "also_see", "$": "verb_group", "&": "similar_to", "<": "participle", "\\": "pertainym",
}
POS = {"n": "NOUN", "v": "VERB", "a": "ADJ", "s": "ADJ", "r": "ADV"}


def read_wordnet(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``synset_id, pos, lex_id, word`` and ``source_id, symbol, relation, target_id`` from ``data.*`` files."""
    lines = spark.read.text(path).where(F.col("value").rlike(r"^[0-9]{8} ")).select(F.split(F.split("value", r" \| ").getItem(0), " ").alias("f"))
    n = F.conv(F.get("f", F.lit(3)), 16, 10).cast("int")
    head = lines.select("f", n.alias("n"), F.concat(F.when(F.get("f", F.lit(2)) == "s", "a").otherwise(F.get("f", F.lit(2))), F.get("f", F.lit(0))).alias("synset_id"), F.get("f", F.lit(2)).alias("p"))
    pos = F.create_map(*[F.lit(x) for kv in POS.items() for x in kv])[F.col("p")]
    words = head.select("synset_id", pos.alias("pos"), F.explode_outer(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(F.get("f", 4 + 2 * i).alias("word"), F.conv(F.get("f", 5 + 2 * i), 16, 10).cast("int").alias("lex_id")))).alias("w"))
    first = 4 + 2 * F.col("n")
    count = F.get("f", first).cast("int")
    pointers = head.where(count > 0).select("synset_id", F.explode_outer(F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(F.get("f", first + 1 + 4 * i).alias("symbol"), F.concat(F.when(F.get("f", first + 3 + 4 * i) == "s", "a").otherwise(F.get("f", first + 3 + 4 * i)), F.get("f", first + 2 + 4 * i)).alias("target_id")))).alias("x"))
    relation = F.coalesce(F.create_map(*[F.lit(x) for kv in POINTERS.items() for x in kv])[F.col("x.symbol")], F.lit("unknown"))
    return words.select("synset_id", "pos", "w.lex_id", "w.word"), pointers.select(F.col("synset_id").alias("source_id"), "x.symbol", relation.alias("relation"), "x.target_id")


def _key(word):
    return F.lower(F.replace(word, F.lit("_"), F.lit(" ")))


def synonyms(terms: DataFrame, words: DataFrame, pos: str | None = None, lex_id: int = -1) -> DataFrame:
    """``term, synset_id, synonym``: other words of the synsets of each term, in any case, ``_`` as a blank."""
    own = words.where((F.lit(pos).isNull()) | (F.col("pos") == pos)).where((F.lit(lex_id) < 0) | (F.col("lex_id") == lex_id))
    met = terms.select("term", _key(F.col("term")).alias("_k")).join(own.select("synset_id", _key(F.col("word")).alias("_k")), "_k")
    return met.join(words.select("synset_id", F.col("word").alias("synonym")), "synset_id").where(_key(F.col("synonym")) != F.col("_k")).select("term", "synset_id", "synonym").distinct()


def related(terms: DataFrame, words: DataFrame, pointers: DataFrame, relation: str | None = None, pos: str | None = None) -> DataFrame:
    """``term, relation, target_id, word``: words of the synsets that each term's synsets point to."""
    own = words.where(F.lit(pos).isNull() | (F.col("pos") == pos)).select(F.col("synset_id").alias("source_id"), _key(F.col("word")).alias("_k"))
    edges = pointers if relation is None else pointers.where(F.col("relation") == relation)
    met = terms.select("term", _key(F.col("term")).alias("_k")).join(own, "_k").join(edges, "source_id")
    return met.join(words.select(F.col("synset_id").alias("target_id"), "word"), "target_id").select("term", "relation", "target_id", "word").distinct()
