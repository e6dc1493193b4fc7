"""Quality classifier: a factorisation machine over hashed words, binned structure statistics and hashed metadata.

score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)), in time linear in the
number of features that a document has.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.shared import held_out

WORD_BUCKETS = 1 << 15
META_BUCKETS = 1 << 12
BINS = 12
#: Structure statistics of a text (shares but for the first four).
STATISTICS = ("log_chars", "log_words", "word_chars", "line_words", "distinct_words", "top_word", "same_as_previous", "repeated_lines", "upper", "digits", "marks", "symbols")
_MEMO_LIMIT = 200_000
AT_ONCE = 256
_UPPER, _DIGIT, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91], _DIGIT[48:58] = True, True
# of the ASCII marks, those of sentences and brackets, and the others
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in "!\"'(),-.:;?[]"]] = True
_SYMBOL[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_SYMBOL &= ~_MARK


def _bucket(word: str, memo: dict[str, int]) -> int:
    got = memo.get(word)
    if got is None:
        if len(memo) >= _MEMO_LIMIT:
            memo.clear()
        h = 2166136261
        for b in word.encode("utf-8", "surrogatepass"):
            h = (h ^ b) * 16777619 & 0xFFFFFFFF
        got = memo[word] = (h ^ h >> 15) % WORD_BUCKETS
    return got


def read_text(text: str | None, memo: dict[str, int]) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Word buckets, their values (of length 1 together) and the statistics of one whole text."""
    text = text or ""
    words = text.lower().split()
    n = len(words)
    counts = Counter(words)
    ids = np.fromiter((_bucket(w, memo) for w in counts), np.int64, len(counts))
    values = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    if n:
        values /= np.sqrt((values**2).sum())
    hist = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8), minlength=256)
    size = max(1, int(hist.sum()))
    lines = [x for x in text.split("\n") if x.strip()]
    stats = [
        np.log1p(len(text)), np.log1p(n), len(text) / max(1, n), np.log1p(n / max(1, len(lines))), len(counts) / max(1, n), max(counts.values(), default=0) / max(1, n),
        sum(map(eq, words, words[1:])) / max(1, n), 1 - len(set(lines)) / max(1, len(lines)), hist[_UPPER].sum() / size, hist[_DIGIT].sum() / size, hist[_MARK].sum() / size, hist[_SYMBOL].sum() / size,
    ]
    return ids, values, stats


@dataclass
class FactorisationMachine:
    edges: np.ndarray  # statistics x (BINS - 1)
    w0: float
    w: np.ndarray
    v: np.ndarray

    def encode(self, ids: list[np.ndarray], values: list[np.ndarray], stats: np.ndarray, meta: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features and values of all texts one after another, and where each text starts. meta: a bucket a column of metadata."""
        if not len(ids):
            return np.zeros(0, int), np.zeros(0), np.zeros(0, int)
        binned = np.stack([np.searchsorted(e, stats[:, j], side="right") for j, e in enumerate(self.edges)], axis=1) + WORD_BUCKETS + META_BUCKETS + np.arange(len(STATISTICS)) * BINS
        if meta is not None:
            binned = np.concatenate([binned, meta + WORD_BUCKETS], axis=1)
        sizes = np.array([len(x) + binned.shape[1] for x in ids])
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        one = np.full(binned.shape[1], 1 / np.sqrt(len(STATISTICS)))
        feature = np.concatenate([y for x, b in zip(ids, binned, strict=True) for y in (x, b)])
        return feature, np.concatenate([y for x in values for y in (x, one)]), starts

    def raw(self, feature: np.ndarray, value: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Raw scores, each text's sums over v, and v x of each feature."""
        vx = self.v[feature] * value[:, None]
        sums = np.add.reduceat(vx, starts, axis=0)
        pairs = 0.5 * ((sums**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
        return self.w0 + np.add.reduceat(self.w[feature] * value, starts) + pairs, sums, vx

    def score(self, ids: list[np.ndarray], values: list[np.ndarray], stats: np.ndarray, meta: np.ndarray | None = None) -> np.ndarray:
        if not len(ids):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.encode(ids, values, stats, meta))[0], -40, 40)))


def fit(ids: list[np.ndarray], values: list[np.ndarray], stats: np.ndarray, labels: np.ndarray, meta: np.ndarray | None = None, rank: int = 8, epochs: int = 8, rate: float = 0.15, decay: float = 1e-5, batch: int = 64, seed: int = 11) -> FactorisationMachine:
    """Minimise log loss by AdaGrad over mini-batches. Labels may be anything from 0 to 1. With no rows every score is 1/2."""
    draw = np.random.default_rng(seed)
    n_features = WORD_BUCKETS + META_BUCKETS + len(STATISTICS) * BINS
    n = len(ids)
    grid = np.linspace(0, 1, BINS + 1)[1:-1]
    edges = np.quantile(stats, grid, axis=0).T if n else np.zeros((len(STATISTICS), BINS - 1))
    m = FactorisationMachine(edges, 0.0, np.zeros(n_features), draw.normal(0, 0.05, (n_features, rank)))
    if not n:
        m.v[:] = 0
        return m
    p = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3))
    m.w0 = float(np.log(p / (1 - p)))
    gw, gv, g0 = np.full(n_features, 1e-6), np.full((n_features, rank), 1e-6), 1e-6
    for _ in range(epochs):
        order = draw.permutation(n)
        for at in range(0, n, batch):
            pick = order[at : at + batch]
            feature, value, starts = m.encode([ids[i] for i in pick], [values[i] for i in pick], stats[pick], None if meta is None else meta[pick])
            raw, sums, vx = m.raw(feature, value, starts)
            err = (1 / (1 + np.exp(-np.clip(raw, -40, 40))) - labels[pick]) / len(pick)
            of = np.repeat(np.arange(len(pick)), np.diff(np.append(starts, len(feature))))
            used, place = np.unique(feature, return_inverse=True)
            d = err[of] * value
            dw = np.bincount(place, d, len(used)) + decay * m.w[used]
            dv_each = d[:, None] * (sums[of] - vx)
            dv = np.stack([np.bincount(place, dv_each[:, f], len(used)) for f in range(rank)], axis=1) + decay * m.v[used]
            g0 += err.sum() ** 2
            gw[used] += dw**2
            gv[used] += dv**2
            m.w0 -= rate * err.sum() / np.sqrt(g0)
            m.w[used] -= rate * dw / np.sqrt(gw[used])
            m.v[used] -= rate * dv / np.sqrt(gv[used])
    return m


def _meta(columns: list[str]) -> Column:
    """A bucket for each column of metadata: of its value, or of its order of magnitude if it is a number; null is a value."""
    value = lambda c: F.coalesce(F.when(F.col(c).try_cast("double").isNotNull(), F.concat(F.lit("~"), F.floor(2 * F.log2(F.abs(F.col(c).try_cast("double")) + 1)).cast("string"))).otherwise(F.col(c).cast("string")), F.lit("null"))
    return F.array(*[F.pmod(F.xxhash64(F.lit(k), value(c)), F.lit(META_BUCKETS)) for k, c in enumerate(columns)]).cast("array<long>")


def _features(batches):
    memo: dict[str, int] = {}
    for pdf in batches:
        got = [read_text(t, memo) for t in pdf["text"]]
        yield pd.DataFrame({"label": pdf["label"], "ids": [x[0].astype(np.int32) for x in got], "vals": [x[1] for x in got], "stats": [np.asarray(x[2]) for x in got], "meta": pdf["meta"]})


def _rows(lists: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a column of lists of numbers, as parts of its buffers."""
    out = []
    for chunk in lists.chunks:
        ends, flat = chunk.offsets.to_numpy(), chunk.values.to_numpy()
        out += [flat[a:b] for a, b in zip(ends, ends[1:])]
    return out


@dataclass
class QualityModel:
    machine: FactorisationMachine
    meta_cols: list[str]


def fit_quality_model(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", meta_cols: list[str] = ()) -> QualityModel:
    """Fit on at most ``sample_rows`` labelled documents, those whose ids hash lowest; held-out ids are never used.

    Several labels of one document are averaged; null labels count for nothing; of several texts of an id the one with
    the least hash is learned from. ``meta_cols`` are columns of ``docs`` whose values are features. Without labelled
    documents the model says 1/2 of everything.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.avg(F.col(label_col).cast("double")).alias("label"))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)  # sample_rows bounds what is broadcast and collected
    texts = docs.select(F.col(id_col).alias("_id"), F.struct(F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"), _meta(list(meta_cols)).alias("meta")).alias("_t"))
    each = texts.join(F.broadcast(picked), "_id").groupBy("_id", "label").agg(F.min("_t").alias("_t"))
    # Arrow's own buffers: lists of Python numbers would take ten times as much of the driver's memory
    got = each.select("label", "_t.text", "_t.meta").mapInPandas(_features, "label double, ids array<int>, vals array<double>, stats array<double>, meta array<long>").toArrow()
    ids, values, stats, meta = (_rows(got[c]) for c in ("ids", "vals", "stats", "meta"))
    label = got["label"].to_numpy()
    key = [x.tobytes() for x in stats]
    order = sorted(range(len(label)), key=lambda i: (key[i], label[i]))  # rows come in no fixed order
    stats = np.array([stats[i] for i in order]).reshape(-1, len(STATISTICS))
    meta = np.array([meta[i] for i in order], np.int64).reshape(len(order), len(meta_cols))
    return QualityModel(fit([ids[i] for i in order], [values[i] for i in order], stats, label[order].astype(float), meta), list(meta_cols))


def score_quality(docs: DataFrame, model: QualityModel, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row, after the columns of ``docs`` named in ``keep``.

    Null and empty texts are scored like any other text, from their statistics; very long ones are read whole. Equal
    texts with equal metadata score the same. Repeated rows are each scored. An empty table gives an empty result.
    Kept columns may have any names and win over columns of the result; others but the metadata aren't read.
    """
    spark: SparkSession = docs.sparkSession
    machine = model.machine
    shipped = spark.sparkContext.broadcast((machine.edges, machine.w0, machine.w, machine.v))  # of a fixed size, whatever the input
    n_meta = len(model.meta_cols)

    @F.pandas_udf("double")
    def score(batches: pd.Series, metas: pd.Series) -> pd.Series:
        memo: dict[str, int] = {}
        model = FactorisationMachine(*shipped.value)
        out = np.empty(len(batches))
        for at in range(0, len(batches), AT_ONCE):  # the factors of so many texts at most are in memory
            got = [read_text(t, memo) for t in batches.iloc[at : at + AT_ONCE]]
            meta = np.array([np.asarray(x) for x in metas.iloc[at : at + AT_ONCE]], np.int64).reshape(len(got), n_meta)
            out[at : at + AT_ONCE] = model.score([x[0] for x in got], [x[1] for x in got], np.array([x[2] for x in got]).reshape(-1, len(STATISTICS)), meta)
        return pd.Series(out)

    kept = keep or []
    scored = docs.select(F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(kept)]).alias("row"), F.col(id_col).alias("id"), score(F.col(text_col), _meta(model.meta_cols)).alias("score"))
    own = {"doc_id": F.col("id"), "held_out": held_out(F.col("id")), "score": F.col("score"), "predicted": (F.col("score") >= threshold).cast("int")}
    taken = {c.lower() for c in kept}
    return scored.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(kept)], *[c.alias(name) for name, c in own.items() if name not in taken])
