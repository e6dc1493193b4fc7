"""Annotators on streams. Per-document stages are stateless and run as they are; what is here keeps state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.operators import pii, stats
from textloom.operators.stats import words


def read_documents(spark: SparkSession, path: str, schema: str = "doc_id long, text string, lang string, source string, n_chars long", files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``term, n`` so far; for complete or update mode."""
    return docs.select(F.explode(words(F.col(text_col))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


def event_windows(events: DataFrame, size: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums in windows of event time, closed by a watermark."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def rehydrate_chunks(chunks: DataFrame, names: dict[str, str]) -> DataFrame:
    """Chunks of answers (``stream_id, seq, chunk``) with cloaked names turned back, though a name may span chunks.

    Each stream holds back as many characters as the longest name has, and lets them go at its last chunk, which is
    the one with a null text. Chunks of a stream come in the order of ``seq``.
    """
    hold = max(map(len, names), default=1) - 1
    ordered = sorted(names, key=lambda n: (-len(n), n))

    def put_back(text: str) -> str:
        for n in ordered:
            text = text.replace(n, names[n])
        return text

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rest = state.get[0] if state.exists else ""
        out = []
        rows = pd.concat(list(batches)).sort_values("seq")
        done = False
        for seq, chunk in zip(rows["seq"], rows["chunk"], strict=True):
            done = chunk is None
            rest += chunk or ""
            cut = len(rest) if done else max(0, len(rest) - hold)
            for n in ordered:  # a name that the cut would divide stays whole
                at = rest.find(n, max(0, cut - len(n) + 1))
                if 0 <= at < cut < at + len(n):
                    cut = at
            if cut:
                out.append((key[0], seq, put_back(rest[:cut])))
                rest = rest[cut:]
        if done:
            state.remove()
        else:
            state.update((rest,))
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text"])

    return chunks.groupBy("stream_id").applyInPandasWithState(step, "stream_id string, seq long, text string", "rest string", "append", "NoTimeout")


def merge_counts(batch: DataFrame, batch_id: int, path: str, key: str = "term", n: str = "n") -> None:
    """For foreachBatch: keep a batch's counts under its id. A batch that is tried again replaces what it wrote before."""
    batch.groupBy(key).agg(F.sum(n).alias(n)).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def merged_counts(spark: SparkSession, path: str, key: str = "term", n: str = "n") -> DataFrame:
    """The counts of all batches together."""
    return spark.read.parquet(path).groupBy(key).agg(F.sum(n).alias(n))


def merge_collocations(batch: DataFrame, batch_id: int, path: str, longest: int = 3, text_col: str = "text") -> None:
    """For foreachBatch: keep a batch's counts of word chains, and its number of words, under its id.

    All chains are kept: which are frequent enough depends on a total that still grows. A batch that is tried again
    replaces what it wrote before.
    """
    grams = stats.n_grams(batch.withColumn("_id", F.lit(0)), *range(2, longest + 1), id_col="_id", text_col=text_col).groupBy("gram").agg(F.count("*").alias("n"))
    total = batch.agg(F.coalesce(F.sum(F.size(words(F.col(text_col)))), F.lit(0)).cast("long").alias("n")).select(F.lit(None).cast("string").alias("gram"), "n")
    grams.unionByName(total).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def merged_collocations(spark: SparkSession, path: str, rare: float = 1e-5, common: float = 0.1) -> DataFrame:
    """``gram, n`` over all batches, as ``stats.collocations`` gives them for all documents at once."""
    counts = spark.read.parquet(path).groupBy("gram").agg(F.sum("n").alias("n"))
    total = counts.where("gram is null").select(F.col("n").alias("_total"))
    kept = F.col("n").between(F.greatest(F.lit(2), F.floor(rare * F.col("_total"))), F.floor(common * F.col("_total")))
    return counts.where("gram is not null").join(F.broadcast(total)).where(kept).drop("_total")  # one row is broadcast


def cloak_batch(batch: DataFrame, batch_id: int, path: str, answer=None, id_col: str = "doc_id", text_col: str = "text", findings_col: str = "findings") -> DataFrame:
    """For foreachBatch: ``batch`` with ``cloaked`` text and its ``mapping``, under names that later batches go on using.

    Names of a batch's new values are kept at ``path`` under its id, numbered by type from where earlier batches ended.
    A batch that is tried again sees the names of earlier ones alone, so it gives the same names again. ``answer`` (a
    function from DataFrame to DataFrame, which may call another service on ``cloaked``) may add ``answer``; its names
    are then turned back in ``rehydrated``.
    """
    spark = batch.sparkSession
    names = f"{path}/names"
    nothing = spark.createDataFrame([], "value string, name string, batch_id int")
    earlier = spark.read.schema("value string, name string, batch_id int").parquet(names).where(F.col("batch_id") < batch_id) if _is_there(spark, names) else nothing
    used = pii.cloak_dictionary(batch, id_col, text_col, findings_col)
    new = used.join(earlier.select("value"), "value", "left_anti")
    number, kind = F.regexp_extract("name", "_([0-9]+)$", 1).cast("long"), F.regexp_replace("name", "_[0-9]+$", "")
    before = earlier.groupBy(kind.alias("kind")).agg(F.max(number).alias("before"))
    own = new.select("value", kind.alias("kind"), number.alias("n")).withColumn("own", F.row_number().over(Window.partitionBy("kind").orderBy("n")))
    named = own.join(before, "kind", "left").select("value", F.concat("kind", F.lit("_"), (F.col("own") + F.coalesce("before", F.lit(0))).cast("string")).alias("name"))
    named.write.mode("overwrite").parquet(f"{names}/batch_id={batch_id}")
    known = spark.read.schema("value string, name string, batch_id int").parquet(names).where(F.col("batch_id") <= batch_id).select("value", "name")
    made = pii.cloak(batch, known, id_col, text_col, findings_col)
    return answer(made).withColumn("rehydrated", pii.rehydrate(F.col("answer"), F.col("mapping"))) if answer else made


def _is_there(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
