"""Readers and writers of document formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.text import clean_text
from textloom.schema import DOCUMENT


def from_texts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Texts as new documents have them: control characters gone, blank ones empty."""
    return df.withColumn(text_col, clean_text(F.col(text_col)))


def from_json(df: DataFrame, col: str = "json") -> DataFrame:
    """A document a row from its JSON."""
    return df.select(F.from_json(col, DOCUMENT).alias("_d")).select("_d.*")


def to_json(df: DataFrame) -> Column:
    """JSON of a document; empty and null fields are left out."""
    fields = [F.when((F.size(c) > 0) if kind.startswith(("array", "map")) else F.col(c).isNotNull(), F.col(c)).alias(c) for c, kind in df.dtypes]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """``path, sentence, text, words, tags, heads, deps`` of CoNLL-U files; word ranges and empty nodes left out.

    A file is read whole: sentences are split at blank lines inside its row.
    """
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    blocks = files.select("path", F.posexplode_outer(F.split("value", r"\r?\n\s*\r?\n")).alias("sentence", "block")).where(F.trim("block") != "")
    rows = F.transform(F.filter(F.split("block", r"\r?\n"), lambda x: x.rlike(r"^[0-9]+\t")), lambda x: F.split(x, "\t"))
    made = blocks.select("path", "sentence", F.regexp_extract("block", r"(?m)^# text = (.*)$", 1).alias("text"), rows.alias("rows"))
    take = lambda k: F.transform("rows", lambda r: F.get(r, F.lit(k)))
    heads = F.transform("rows", lambda r: F.coalesce(F.get(r, F.lit(6)).try_cast("int"), F.lit(0)) - 1)
    return made.select("path", "sentence", "text", take(1).alias("words"), take(3).alias("tags"), heads.alias("heads"), take(7).alias("deps"))


def read_wikiner(spark: SparkSession, path: str) -> DataFrame:
    """``line, words, pos, tags`` of ``word|pos|tag`` lines; I- and B- runs as B/I/L/U tags, MISC as O."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.xxhash64("value").alias("line"), F.transform(F.split("value", " "), lambda x: F.split(x, r"\|")).alias("cells"))
    kind = lambda c: F.when(F.get(c, F.lit(2)).rlike("^[BI]-") & ~F.get(c, F.lit(2)).endswith("MISC"), F.substring(F.get(c, F.lit(2)), F.lit(3), F.length(F.get(c, F.lit(2)))))
    starts = lambda c: F.coalesce(F.get(c, F.lit(2)).startswith("B-"), F.lit(False))
    kinds, begins = F.transform("cells", kind), F.transform("cells", starts)
    made = lines.select("line", F.transform("cells", lambda c: F.get(c, F.lit(0))).alias("words"), F.transform("cells", lambda c: F.get(c, F.lit(1))).alias("pos"), kinds.alias("k"), begins.alias("b"))

    def tag(k, i):
        first = ~F.get("k", i - 1).eqNullSafe(k) | F.get("b", i)
        last = ~F.get("k", i + 1).eqNullSafe(k) | F.coalesce(F.get("b", i + 1), F.lit(False))
        return F.when(k.isNull(), "O").otherwise(F.concat(F.when(first & last, "U-").when(first, "B-").when(last, "L-").otherwise("I-"), k))

    return made.select("line", "words", "pos", F.transform("k", tag).alias("tags"))


def read_sentence_tsv(spark: SparkSession, path: str) -> DataFrame:
    """``id, lang, text`` of tab-separated lines."""
    return spark.read.csv(path, sep="\t", schema="id long, lang string, text string", quote="")


def read_language_profiles(spark: SparkSession, path: str) -> DataFrame:
    """``lang, gram, p`` of profile files: ``{name, freq: {gram: count}, n_words: [by length]}``."""
    read = spark.read.json(path, multiLine=True, schema="name string, freq map<string,long>, n_words array<long>")
    return read.select(F.col("name").alias("lang"), F.explode_outer("freq").alias("gram", "n"), "n_words").where("gram is not null").select("lang", "gram", F.try_divide(F.col("n"), F.get("n_words", F.length("gram") - 1)).alias("p"))


def read_bilingual(spark: SparkSession, path: str) -> DataFrame:
    """``ix, word, translation``: the first translation of each word."""
    read = spark.read.text(path).select(F.monotonically_increasing_id().alias("ix"), F.split(F.trim("value"), r"\s+").alias("w")).where(F.size("w") == 2)
    pairs = read.select("ix", F.get("w", F.lit(0)).alias("word"), F.get("w", F.lit(1)).alias("translation"))
    return pairs.withColumn("_r", F.row_number().over(Window.partitionBy("word").orderBy("ix"))).where("_r = 1").drop("_r")


def read_categorised(spark: SparkSession, folder: str) -> DataFrame:
    """``path, split, text, labels`` of a corpus with one text a file and a list of ``path label label ...``."""
    labels = spark.read.text(f"{folder}/cats.txt").select(F.split(F.trim("value"), r"\s+").alias("w")).select(F.get("w", F.lit(0)).alias("path"), F.slice("w", F.lit(2), F.size("w")).alias("labels"))
    texts = spark.read.text([f"{folder}/training", f"{folder}/test"], wholetext=True).select(F.regexp_extract(F.input_file_name(), r"((?:training|test)/[^/]+)$", 1).alias("path"), F.col("value").alias("text"))
    return texts.join(labels, "path", "left").select("path", F.split("path", "/").getItem(0).alias("split"), "text", "labels")
