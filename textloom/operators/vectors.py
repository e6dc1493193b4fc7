"""Vectors: subword hashing, word and document vectors, neighbours, quantisation, alignment, topics and classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.tables import Scope


def subwords(word: Column, least: int = 3, most: int = 6, buckets: int = 2_000_000) -> Column:
    """Buckets of the character n-grams of ``<word>``."""
    marked = F.concat(F.lit("<"), word, F.lit(">"))

    def of_size(t: Column, n: int) -> Column:
        parts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - n + 1, F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))
        return F.when(F.length(t) >= n, parts).otherwise(F.array().cast("array<string>"))

    made = lambda t: F.flatten(F.array(*[of_size(t, n) for n in range(least, most + 1)]))
    return F.transform(F.get(F.transform(F.array(marked), made), F.lit(0)), lambda g: F.pmod(F.xxhash64(g), F.lit(buckets)))


def word_ngrams(words: Column, most: int = 2) -> Column:
    """Word n-grams of 2 to ``most`` words."""


    def of_size(n: int) -> Column:
        return F.transform(F.slice(words, 1, F.greatest(F.size(words) - n + 1, F.lit(0))), lambda x, i: F.array_join(F.slice(words, i + 1, n), " "))

    return F.flatten(F.array(*[of_size(n) for n in range(2, most + 1)]))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def centroids(vectors: DataFrame, key: str, vec: str = "embedding") -> DataFrame:
    """``key, ix, mean``: the mean of each dimension, combined before the shuffle."""
    return vectors.select(key, F.posexplode_outer(vec).alias("ix", "x")).where("ix is not null").groupBy(key, "ix").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def most_similar(queries: DataFrame, vectors: DataFrame, k: int = 10, id_col: str = "vec_id", vec: str = "embedding", block_rows: int = 65_536) -> DataFrame:
    """``query_id, vec_id, cosine, rank``: the k nearest by cosine of each of a stated set of queries, exactly.

    Queries go out in blocks of about ``block_rows``, one pass over the vectors each; a task keeps its own k best of
    every query before they are shuffled. Ids are integers; of equal cosines the lower id comes first. Null and empty
    vectors, and those of another length than the first query's, are neither queries nor neighbours.
    """
    import numpy as np
    import pandas as pd

    packed = queries.select(F.col(id_col).alias("id"), F.col(vec).alias("q")).where("size(q) > 0 and id is not null")
    least = packed.orderBy("id").limit(1).collect()
    width = len(least[0].q) if least else 0
    packed = packed.where(F.size("q") == width)
    n_blocks = max(1, -(-packed.count() // block_rows))

    def pass_over(block: int) -> DataFrame:
        rows = packed.where(F.pmod(F.xxhash64("id"), F.lit(n_blocks)) == block).collect()  # block_rows bounds them
        ids, q = np.asarray([r.id for r in rows], np.int64), np.asarray([r.q for r in rows], np.float32).reshape(len(rows), -1)
        q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
        shipped = queries.sparkSession.sparkContext.broadcast((ids, q))

        def best(batches):
            ids, q = shipped.value
            held = [[] for _ in ids]
            for pdf in batches:
                if not len(pdf) or not len(ids):
                    continue
                v = np.stack(pdf["v"].to_numpy()).astype(np.float32)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                own = pdf["id"].to_numpy()
                for at in range(0, len(ids), 1024):
                    score = q[at : at + 1024] @ v.T
                    # all that are as near as the last of the k + 1 nearest, so that ties are settled by id
                    last = -np.partition(-score, min(k, score.shape[1] - 1), axis=1)[:, min(k, score.shape[1] - 1)]
                    for i, cut in enumerate(last, at):
                        more = [(float(score[i - at, c]), int(own[c])) for c in np.flatnonzero(score[i - at] >= cut) if own[c] != ids[i]]
                        held[i] = sorted(held[i] + more, key=lambda x: (-x[0], x[1]))[:k]
            yield pd.DataFrame([(int(i), c, s) for i, xs in zip(ids, held, strict=True) for s, c in xs], columns=["query_id", "vec_id", "cosine"])

        return vectors.select(F.col(id_col).alias("id"), F.col(vec).alias("v")).where((F.size("v") == width) & F.col("id").isNotNull()).mapInPandas(best, "query_id long, vec_id long, cosine double")

    near = pass_over(0)
    for block in range(1, n_blocks):
        near = near.union(pass_over(block))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def quantise(vec: Column, bits: int = 1) -> Column:
    """Each number as one of 2^bits levels of equal width over the vector's range (1 bit: the sign)."""
    if bits == 1:
        return F.transform(vec, lambda x: F.when(x >= 0, 1.0).otherwise(-1.0))
    top = F.greatest(F.array_max(F.transform(vec, lambda x: F.abs(x))), F.lit(1e-12))
    steps = (1 << bits) - 1
    return F.transform(vec, lambda x: F.round((x / top + 1) / 2 * steps) / steps * 2 * top - top)


def document_vectors(tokens: DataFrame, word_vectors: DataFrame) -> DataFrame:
    """``doc_id, ix, mean``: mean of the vectors of a document's words. word_vectors: term, vector."""
    return centroids(tokens.join(word_vectors, "term"), "doc_id", "vector")


def vector_of_word(word_parts: DataFrame, part_vectors: DataFrame) -> DataFrame:
    """``word, ix, mean``: vectors of words, known or not, as the mean over their subwords. word_parts: word, parts."""
    parts = word_parts.select("word", F.explode_outer("parts").alias("bucket"))
    return centroids(parts.join(part_vectors, "bucket"), "word", "vector")


def sentence_contributions(sentences: DataFrame, target: DataFrame, vec: str = "vector") -> DataFrame:
    """``doc_id, ix, contribution``: cosine to the target with all sentences, less that without this one.

    sentences: doc_id, ix, vector (sums of word vectors); target: doc_id, vector.
    """
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    whole = sentences.groupBy("doc_id").agg(F.collect_list(vec).alias("_all"))
    summed = whole.select("doc_id", F.aggregate(F.slice("_all", 2, F.size("_all")), F.get("_all", F.lit(0)), plus).alias("_sum"))
    beside = sentences.join(summed, "doc_id").join(target.select("doc_id", F.col(vec).alias("_target")), "doc_id")
    rest = F.zip_with("_sum", vec, lambda x, y: x - y)
    return beside.select("doc_id", "ix", (cosine(F.col("_sum"), F.col("_target")) - F.coalesce(cosine(rest, F.col("_target")), F.lit(0.0))).alias("contribution"))


def align(pairs: DataFrame, source: str = "source", target: str = "target"):
    """The orthogonal map W for which source W is nearest to target (Procrustes): a dim x dim sum, then one small SVD."""
    import numpy as np

    i = pairs.select(F.posexplode(source).alias("i", "a"), target).select("i", "a", F.posexplode(target).alias("j", "b"))
    cells = i.groupBy("i", "j").agg(F.sum(F.col("a").cast("double") * F.col("b").cast("double")).alias("m")).collect()
    n = 1 + max((r.i for r in cells), default=0)
    m = np.zeros((n, n))
    for r in cells:
        m[r.i, r.j] = r.m
    u, _, vt = np.linalg.svd(m)
    return u @ vt


def translate(vec: Column, w) -> Column:
    """A row vector times the map."""
    return F.array(*[dot(vec, F.array(*[F.lit(float(x)) for x in w[:, j]])) for j in range(w.shape[1])])


def translation_pairs(dictionary: DataFrame, source: DataFrame, target: DataFrame, limit: int = 10_000) -> DataFrame:
    """Vectors of the dictionary's word pairs (``source``, ``target``), the first translation of each word, in order of ``ix``."""
    first = dictionary.withColumn("_r", F.row_number().over(Window.partitionBy("word").orderBy("ix"))).where("_r = 1")
    met = first.join(source.select(F.col("term").alias("word"), F.col("vector").alias("source")), "word").join(target.select(F.col("term").alias("translation"), F.col("vector").alias("target")), "translation")
    return met.orderBy("ix").limit(limit).select("word", "translation", "source", "target")


def fit_topics(docs: DataFrame, words_col: str = "words", topics: int = 20, vocabulary: int = 20_000, iterations: int = 20, seed: int = 7):
    """A pipeline model of counts and latent Dirichlet allocation; the vector of a document is in ``topics``.

    Every iteration reads all documents, so steps start large (``learningOffset`` 1). What it reads are the counts, written
    once as a table: from the documents themselves words would be cut and counted anew in each iteration.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.clustering import LDA
    from pyspark.ml.feature import CountVectorizer

    counter = CountVectorizer(inputCol=words_col, outputCol="counts", vocabSize=vocabulary, minDF=2).fit(docs)
    with Scope(docs.sparkSession) as scope:
        counts = scope.write(counter.transform(docs).select("counts"), "topics-counts")
        lda = LDA(featuresCol="counts", topicDistributionCol="topics", k=topics, maxIter=iterations, optimizer="online", subsamplingRate=1.0, learningOffset=1.0, seed=seed).fit(counts)
    return PipelineModel(stages=[counter, lda])


def describe_topics(model, terms: int = 10) -> DataFrame:
    """``topic, rank, term, weight``."""
    words = model.stages[0].vocabulary
    spark = model.stages[1].describeTopics(1).sparkSession
    names = spark.createDataFrame(list(enumerate(words)), "_i int, term string")
    each = model.stages[1].describeTopics(terms).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "_t"))
    return each.join(names, F.col("_t.termIndices") == F.col("_i")).select("topic", "rank", "term", F.col("_t.termWeights").alias("weight"))


def topic_words(words: Column, stop_words: list[str] = ()) -> Column:
    """Words for topics: letters and digits alone, three or more, no stop word, no ordinal."""
    kept = F.filter(words, lambda w: (F.length(w) >= 3) & w.rlike(r"^[\p{L}\p{Nd}]+$") & ~w.rlike(r"^[0-9]+(?:st|nd|rd|th)$"))
    return F.array_except(kept, F.array(*[F.lit(s) for s in stop_words])) if stop_words else kept


def fit_classifier(docs: DataFrame, label_col: str, words_col: str = "words", buckets: int = 1 << 16, iterations: int = 30):
    """A linear classifier over hashed words and word pairs, one against the rest for more than two labels."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, NGram, SQLTransformer

    stages = [
        NGram(n=2, inputCol=words_col, outputCol="_pairs"),
        SQLTransformer(statement=f"SELECT *, concat({words_col}, _pairs) AS _all FROM __THIS__"),
        HashingTF(inputCol="_all", outputCol="_features", numFeatures=buckets),
        LogisticRegression(featuresCol="_features", labelCol=label_col, maxIter=iterations, regParam=1e-3),
    ]
    return Pipeline(stages=stages).fit(docs)
