"""Embeddings of words and labels learned by ranking, and search over classifier settings.

Each epoch every partition takes gradient steps on its own copy of the vectors, which are then averaged over the
partitions that moved them; vocabularies are bounded, so what is sent around is too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rank_embedding(examples: DataFrame, left: str = "words", right: str = "labels", dim: int = 64, epochs: int = 5, rate: float = 0.05, margin: float = 0.05, negatives: int = 10, max_terms: int = 200_000, seed: int = 7) -> DataFrame:
    """``side, term, vector``: vectors for which the mean of a row's left terms is nearer (by cosine) to its right terms
    than to terms drawn at random, by a margin. Pairs of words and labels give tag vectors, of a sentence and another
    of its text sentence vectors, of related items relation vectors. The most frequent ``max_terms`` of a side count.
    """
    sides = {}
    for name in (left, right):
        counted = examples.select(F.explode(name).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
        sides[name] = {r.term: i for i, r in enumerate(counted.orderBy(F.desc("n"), "term").limit(max_terms).collect())}
    draw = np.random.default_rng(seed)
    held = {name: draw.normal(0, 1 / dim, (len(ix), dim)).astype(np.float32) for name, ix in sides.items()}
    context = examples.sparkSession.sparkContext
    names = context.broadcast(sides)
    rows = examples.select(F.col(left).alias("l"), F.col(right).alias("r"))
    for epoch in range(epochs):
        start = context.broadcast(held)

        def learn(batches: Iterator[pd.DataFrame], start=start, epoch=epoch) -> Iterator[pd.DataFrame]:
            a, b = start.value[left].copy(), start.value[right].copy()
            ia, ib = names.value[left], names.value[right]
            moved = {left: set(), right: set()}
            own = np.random.default_rng(seed + epoch)
            for pdf in batches:
                for ls, rs in zip(pdf["l"], pdf["r"], strict=True):
                    p = [ia[x] for x in ls if x in ia] if ls is not None else []
                    q = [ib[x] for x in rs if x in ib] if rs is not None else []
                    if not p or not q:
                        continue
                    x = a[p].mean(0)
                    x_norm = np.linalg.norm(x) + 1e-9
                    good = int(own.choice(q))
                    bad = own.integers(0, len(b), negatives)
                    bad = bad[~np.isin(bad, q)]
                    unit = b / (np.linalg.norm(b, axis=1, keepdims=True) + 1e-9) if len(b) <= 64 else None
                    of = lambda k, unit=unit: unit[k] if unit is not None else b[k] / (np.linalg.norm(b[k], axis=-1, keepdims=True) + 1e-9)
                    s_good, s_bad = float(of(good) @ x) / x_norm, of(bad) @ x / x_norm
                    wrong = bad[s_bad > s_good - margin]
                    if not len(wrong):
                        continue
                    push = of(good) - of(wrong).mean(0)
                    a[p] += rate * push
                    b[good] += rate * x / x_norm
                    b[wrong] -= rate * x / x_norm / len(wrong)
                    moved[left].update(p)
                    moved[right].update([good, *wrong.tolist()])
            out = [(side, int(k), m[k].astype(float)) for side, m in ((left, a), (right, b)) for k in moved[side]]
            yield pd.DataFrame(out, columns=["side", "ix", "vector"])

        made = rows.mapInPandas(learn, "side string, ix int, vector array<double>")
        means = made.select("side", "ix", F.posexplode("vector").alias("d", "x")).groupBy("side", "ix", "d").agg(F.avg("x").alias("x"))
        packed = means.groupBy("side", "ix").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("v")).select("side", "ix", F.transform("v", lambda s: s["x"]).alias("v"))
        held = {k: v.copy() for k, v in held.items()}
        for r in packed.toLocalIterator():
            held[r.side][r.ix] = r.v
        start.unpersist()
    spark = examples.sparkSession
    return spark.createDataFrame([(side, term, held[side][i].tolist()) for side, ix in sides.items() for term, i in ix.items()], "side string, term string, vector array<double>")


def tuned_classifier(docs: DataFrame, label_col: str, words_col: str = "words", buckets: tuple[int, ...] = (1 << 12, 1 << 16), penalties: tuple[float, ...] = (1e-4, 1e-2), train_share: float = 0.8, seed: int = 7):
    """The best linear classifier over a grid of sizes and penalties, by F1 on rows held back."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit

    hashing, linear = HashingTF(inputCol=words_col, outputCol="_features"), LogisticRegression(featuresCol="_features", labelCol=label_col, maxIter=20)
    grid = ParamGridBuilder().addGrid(hashing.numFeatures, list(buckets)).addGrid(linear.regParam, list(penalties)).build()
    judge = MulticlassClassificationEvaluator(labelCol=label_col, metricName="f1")
    return TrainValidationSplit(estimator=Pipeline(stages=[hashing, linear]), estimatorParamMaps=grid, evaluator=judge, trainRatio=train_share, seed=seed).fit(docs).bestModel
