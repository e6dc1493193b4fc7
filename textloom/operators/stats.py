"""Corpus statistics over exploded tokens: aggregations that combine on the map side before they shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.chars import shape


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), 1)


def exploded_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *kept: str) -> DataFrame:
    """``doc_id, ix, term``; explode_outer because the optimiser guards a plain explode by computing its array twice."""
    return docs.select(F.col(id_col).alias("doc_id"), *kept, F.posexplode_outer(words(F.col(text_col))).alias("ix", "term")).where("term is not null")


def document_frequency(tokens: DataFrame) -> DataFrame:
    """``term, df`` of exploded tokens (``doc_id, term``)."""
    return tokens.select("doc_id", "term").distinct().groupBy("term").agg(F.count("*").alias("df"))


def term_frequency(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def tf_idf(tokens: DataFrame, n_docs: int, min_share: float | None = None) -> DataFrame:
    """``doc_id, term, tf, df, score``: (1 + log10 tf) ln(N / (1 + df)); terms of df at most floor(min_share N) left out."""
    tf = term_frequency(tokens)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    if min_share is not None:
        df = df.where(F.col("df") > math.floor(min_share * n_docs))
    return tf.join(df, "term").select("doc_id", "term", "tf", "df", ((1 + F.log10("tf")) * F.log(n_docs / (1 + F.col("df")))).alias("score"))


def top_per(df: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    """The first k rows of each key; a rank limit that Spark applies before the shuffle as well."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def vocabulary(tokens: DataFrame, min_count: int = 5) -> DataFrame:
    return tokens.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def most_frequent(vocab: DataFrame, k: int) -> DataFrame:
    """``term, n, rank`` of the k most frequent terms, ties by name."""
    first = vocab.orderBy(F.desc("n"), "term").limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "term")).cast("long"))  # of k rows


def single_tag_terms(tokens: DataFrame, tag: str, more_than: int = 20) -> DataFrame:
    """Terms seen more than so often and always with one tag."""
    return tokens.groupBy("term").agg(F.count("*").alias("n"), F.min(tag).alias(tag), F.max(tag).alias("_most")).where((F.col("n") > more_than) & (F.col(tag) == F.col("_most"))).drop("_most")


def n_grams(docs: DataFrame, *sizes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, gram`` for each run of so many words; a text is cut once for all sizes."""

    def runs(w: Column) -> Column:
        of = lambda n: lambda x, i: F.concat_ws(" ", x, *[F.get(w, i + j) for j in range(1, n)])
        return F.concat(*[F.transform(F.slice(w, 1, F.greatest(F.size(w) - n + 1, F.lit(0))), of(n)) for n in sizes])

    bound = F.get(F.transform(F.array(words(F.col(text_col))), runs), F.lit(0))
    return docs.select(F.col(id_col).alias("doc_id"), F.explode_outer(bound).alias("gram")).where("gram is not null")


def collocations(docs: DataFrame, longest: int = 3, rare: float = 1e-5, common: float = 0.1, id_col: str = "doc_id", text_col: str = "text", stop_words: list[str] = ()) -> DataFrame:
    """``gram, n``: word chains of 2 to ``longest`` words whose count is between max(2, rare T) and common T of T words."""
    total = docs.agg(F.sum(F.size(words(F.col(text_col))))).first()[0] or 0
    grams = n_grams(docs, *range(2, longest + 1), id_col=id_col, text_col=text_col)
    if stop_words:
        grams = grams.where(~F.arrays_overlap(F.split("gram", " "), F.array(*[F.lit(w) for w in stop_words])))
    return grams.groupBy("gram").agg(F.count("*").alias("n")).where(F.col("n").between(max(2, math.floor(rare * total)), math.floor(common * total)))


def appearances(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``doc_id, item_id`` of each item whose whole text stands somewhere in a document's, whatever the case; an item may
    begin and end inside a word.

    What lies between an item's first and last word are whole words of the document too, so items of five words or more
    are met by the three words after the first one and then compared; shorter ones are compared with each document (a
    nested join with the items as the side that Spark sends round). Ids are expected to be different. Null texts match nothing, an empty item
    every document with a text.
    """
    three = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    bound_ = lambda w: F.get(F.transform(F.array(w), three), F.lit(0))
    asked = items.select(F.col(item_id_col).alias("item_id"), F.lower(item_text_col).alias("_item"), words(F.col(item_text_col)).alias("_w")).where("_item is not null")
    own = docs.select(F.col(id_col).alias("doc_id"), F.lower(text_col).alias("_text"))
    long = asked.where(F.size("_w") >= 5).select("item_id", "_item", F.get(bound_(F.col("_w")), F.lit(1)).alias("_k"))
    met = docs.select(F.col(id_col).alias("doc_id"), F.explode_outer(F.array_distinct(bound_(words(F.col(text_col))))).alias("_k")).where("_k is not null").join(long, "_k").select("doc_id", "item_id", "_item").distinct()
    short = asked.where(F.size("_w") < 5).select("item_id", "_item")
    found = met.join(own, "doc_id").where(F.contains("_text", "_item")).select("doc_id", "item_id")
    return found.unionByName(own.join(short, F.contains("_text", "_item")).select("doc_id", "item_id"))


def shape_histogram(tokens: DataFrame, examples: int = 50, compact: bool = False) -> DataFrame:
    """``shape, n, examples``: at most so many distinct terms of each shape, the first ones in order."""
    per_term = tokens.groupBy("term").agg(F.count("*").alias("n")).withColumn("shape", shape(F.col("term"), compact))
    first = top_per(per_term, "shape", examples, F.asc("term")).groupBy("shape").agg(F.array_sort(F.collect_list("term")).alias("examples"))
    return per_term.groupBy("shape").agg(F.sum("n").alias("n")).join(first, "shape")


def precision_recall(scored: DataFrame, score: str, label: str, cutoffs: list[float]) -> DataFrame:
    """Precision, recall and F1 of ``score >= cutoff`` against a 0/1 label, one row a cutoff, in one pass."""
    each = scored.select(F.col(label).cast("int").alias("y"), F.explode(F.transform(F.array(*[F.lit(c) for c in cutoffs]), lambda c: F.struct(c.alias("cutoff"), (F.col(score) >= c).cast("int").alias("p")))).alias("_c")).select("y", "_c.*")
    sums = each.groupBy("cutoff").agg(F.sum(F.col("p") * F.col("y")).alias("tp"), F.sum("p").alias("positive"), F.sum("y").alias("actual"))
    precision, recall = F.try_divide("tp", "positive"), F.try_divide("tp", "actual")
    return sums.select("cutoff", "tp", "positive", "actual", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * precision * recall, precision + recall).alias("f1"))


def pipeline_statistics(docs: DataFrame, sentences: str = "spans", tokens: str = "tokens") -> DataFrame:
    return docs.agg(F.count("*").alias("n_docs"), F.sum(F.size(sentences)).alias("n_sentences"), F.sum(F.size(tokens)).alias("n_tokens"))


def discard_probability(share: Column, threshold: float = 1e-4) -> Column:
    """How likely a frequent word is left out of training: 1 - sqrt(t / f), not below 0."""
    return F.greatest(F.lit(0.0), 1 - F.sqrt(F.lit(threshold) / share))


def negative_sampling(vocab: DataFrame) -> DataFrame:
    """``term, p``: chance of a word as a negative example, as the root of its count. The total is a row beside each,
    so nothing runs before the result is asked for."""
    total = vocab.agg(F.sum(F.sqrt("n")).alias("_total")).withColumn("_one", F.lit(1))
    return vocab.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").select("term", (F.sqrt("n") / F.col("_total")).alias("p"))


def context_window(tokens: DataFrame, k: int = 2, *keys: str) -> DataFrame:
    """Each token beside its k neighbours on either side, in its document."""
    w = Window.partitionBy(*(keys or ("doc_id",))).orderBy("ix")
    return tokens.select("*", *[(F.lag("term", -j) if j < 0 else F.lead("term", j)).over(w).alias(f"{'next' if j > 0 else 'previous'}_{abs(j)}") if j > 0 else F.lag("term", -j).over(w).alias(f"previous_{-j}") for j in range(-k, k + 1) if j])


def bilou(tags: DataFrame, tag: str = "tag", *keys: str) -> DataFrame:
    """Tags of runs (the type, or null) turned into B, I, L, O, U with the type, from the neighbours' tags."""
    w = Window.partitionBy(*(keys or ("doc_id",))).orderBy("ix")
    same_before, same_after = F.lag(tag).over(w).eqNullSafe(F.col(tag)), F.lead(tag).over(w).eqNullSafe(F.col(tag))
    letter = F.when(~same_before & ~same_after, "U").when(~same_before, "B").when(same_after, "I").otherwise("L")
    return tags.withColumn("bilou", F.when(F.col(tag).isNull(), "O").otherwise(F.concat(letter, F.lit("-"), F.col(tag))))
