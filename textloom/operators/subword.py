"""Vectors over hashed subwords, for words, documents and labels, trained on blocks of documents.

A word is the mean of the vectors of its own bucket and of those of its character n-grams, so words that were never seen
have vectors too. Parameters are a table with a row a vector. In each epoch every block of documents meets the vectors
that it needs (a cogroup), makes one pass over its examples from them, and gives back what it moved; what several blocks
moved is averaged. So neither the driver nor a task holds more vectors than a block's words have, however many buckets,
words and documents there are.

Tables of parameters have ``side, key, vector``; sides are 0 for buckets, 1 for what is predicted (words by their hash,
labels by their place, or inner nodes of a Huffman tree from -1 down), and 2 for documents by their hash.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators import stats
from textloom.tables import Scope

#: ``document`` predicts words from their document alone, ``document_cbow`` from it and the words around them.
MODELS = ("skipgram", "cbow", "document", "document_cbow")
LOSSES = ("negative", "hierarchical", "softmax", "one_vs_all")
#: Words (or inputs of labelled documents) of a block.
BLOCK_WORDS = 400_000
PARAMETERS = "side int, key long, vector array<double>"


def bucket_of(text: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(text), F.lit(buckets))


def subwords(word: Column, buckets: int, least: int = 3, most: int = 6) -> Column:
    """Buckets of a word: its own, and those of the n-grams of its characters between ``<`` and ``>``."""
    framed = F.concat(F.lit("<"), word, F.lit(">"))
    of = lambda n: F.when(F.length(framed) >= n, F.transform(F.sequence(F.lit(1), F.length(framed) - n + 1), lambda i: bucket_of(F.substring(framed, i, F.lit(n)), buckets))).otherwise(F.array().cast("array<bigint>"))
    return F.concat(F.array(bucket_of(framed, buckets)), *[of(n) for n in range(least, most + 1)])


def document_inputs(words: Column, buckets: int, word_ngrams: int = 2) -> Column:
    """Buckets of a document's words, of their n-grams of characters, and of its n-grams of words."""
    run = lambda n: lambda x, i: bucket_of(F.array_join(F.slice(words, i + 1, F.lit(n)), " "), buckets)
    runs = [F.transform(F.slice(words, 1, F.greatest(F.size(words) - n + 1, F.lit(0))), run(n)) for n in range(2, word_ngrams + 1)]
    return F.concat(F.flatten(F.transform(words, lambda x: subwords(x, buckets))), *runs)


def vocabulary(docs: DataFrame, min_count: int = 1, threshold: float = 1e-4, buckets: int = 1 << 21, words_col: str = "words") -> DataFrame:
    """``word, key, n, keep, parts``: words seen ``min_count`` times or more, how likely an occurrence is kept, and their
    buckets. The total is a row beside each."""
    counted = docs.select(F.explode_outer(words_col).alias("word")).where("word is not null").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    total = counted.agg(F.sum("n").alias("_total"))
    kept = 1 - stats.discard_probability(F.col("n") / F.col("_total"), threshold)
    return counted.join(F.broadcast(total)).select("word", F.xxhash64("word").alias("key"), "n", kept.alias("keep"), subwords(F.col("word"), buckets).alias("parts"))  # one row is broadcast


def huffman(counts: list[tuple[int, int]]) -> dict[int, tuple[list[int], list[int]]]:
    """For each key its inner nodes from the root on, numbered from -1 down, and the turn taken at each (0 or 1).

    The least counts are joined first, ties by key, so that a frequent key has a short path.
    """
    heap = [(n, k, key) for k, (key, n) in enumerate(sorted(counts, key=lambda x: (x[1], x[0])))]
    parent: dict[tuple[bool, int], tuple[int, int]] = {}
    leaves, node = {k: key for _, k, key in heap}, 0
    heap = [(n, k, (True, k)) for n, k, _ in heap]
    heapq.heapify(heap)
    while len(heap) > 1:
        node -= 1
        (n_0, _, low), (n_1, _, high) = heapq.heappop(heap), heapq.heappop(heap)
        parent[low], parent[high] = (node, 0), (node, 1)
        heapq.heappush(heap, (n_0 + n_1, len(leaves) - node, (False, node)))
    paths = {}
    for k, key in leaves.items():
        nodes, turns, at = [], [], (True, k)
        while at in parent:
            above, turn = parent[at]
            nodes.append(above)
            turns.append(turn)
            at = (False, above)
        paths[key] = nodes[::-1], turns[::-1]
    return paths


def _paths(spark, targets: DataFrame) -> DataFrame:
    """``key, nodes, turns`` of a tree over ``key, n``: made on the driver, which what is predicted bounds."""
    made = huffman([(r["key"], r["n"]) for r in targets.select("key", "n").toLocalIterator()])
    return spark.createDataFrame([(k, nodes, turns) for k, (nodes, turns) in made.items()], "key long, nodes array<long>, turns array<int>")


def _start(keys: np.ndarray, dim: int, seed: int) -> np.ndarray:
    """Small vectors that depend on key and seed only, so that every block begins with the same."""
    x = (keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)) + (np.arange(1, dim + 1, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) + np.uint64(seed)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(29)
    return ((x >> np.uint64(11)).astype(np.float64) / (1 << 53) * 2 - 1) / dim


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _mean(inputs: np.ndarray, rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mean input of each example; the different inputs of all, and their shares in each example."""
    ids, at = np.unique(np.concatenate(rows), return_inverse=True)
    sizes = np.array([len(r) for r in rows])
    shares = np.bincount(np.repeat(np.arange(len(rows)), sizes) * len(ids) + at, minlength=len(rows) * len(ids)).reshape(len(rows), -1) / sizes[:, None]
    return shares @ inputs[ids], ids, shares


def binary_step(inputs: np.ndarray, outputs: np.ndarray, rows: list[np.ndarray], outs: np.ndarray, wanted: np.ndarray, there: np.ndarray, rate: float, frozen: bool = False) -> float:
    """One step on examples that each have some outputs ``wanted`` to be 1 or 0 (where ``there``), in place; gives back
    the summed loss. It serves negative sampling (a target and others) and trees (the turns of a path). ``frozen``
    outputs stay as they are."""
    h, ids, shares = _mean(inputs, rows)
    p = _sigmoid(np.einsum("bd,bkd->bk", h, outputs[outs]))
    g = (p - wanted) * there
    back = np.einsum("bk,bkd->bd", g, outputs[outs])
    if not frozen:
        np.add.at(outputs, outs, -rate * g[:, :, None] * h[:, None, :])
    inputs[ids] -= rate * (shares.T @ back)
    return float(-(np.log(np.maximum(np.where(wanted == 1, p, 1 - p), 1e-12)) * there).sum())


def whole_step(inputs: np.ndarray, outputs: np.ndarray, rows: list[np.ndarray], target: np.ndarray, loss: str, rate: float) -> float:
    """One step over all outputs: softmax, or each output against the others."""
    h, ids, shares = _mean(inputs, rows)
    score = h @ outputs.T
    e = np.exp(score - score.max(1, keepdims=True))
    p = e / e.sum(1, keepdims=True) if loss == "softmax" else _sigmoid(score)
    wanted = np.zeros(p.shape)
    wanted[np.arange(len(target)), target] = 1
    g = p - wanted
    back = g @ outputs
    outputs -= rate * g.T @ h
    inputs[ids] -= rate * (shares.T @ back)
    right = p[wanted == 1] if loss == "softmax" else np.where(wanted == 1, p, 1 - p)
    return float(-np.log(np.maximum(right, 1e-12)).sum())


def _lists(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and values of a column of lists; a null one is empty."""
    lists = table.column(name).combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)


def _each(table: pa.Table, name: str) -> list[np.ndarray]:
    bounds, values = _lists(table, name)
    return [values[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


class _Block:
    """Vectors of one block under local numbers, and its words."""

    def __init__(self, rows: pa.Table, dim: int, seed: int):
        held = rows.filter(pc.less(rows.column("side"), 3))
        self.sides, self.keys = held.column("side").to_numpy(), held.column("key").to_numpy()
        self.table = _start(self.keys, dim, seed)
        self.table[self.sides == 1] = 0
        bounds, vectors = _lists(held, "vector")
        self.table[np.diff(bounds) > 0] = vectors.reshape(-1, dim)
        own = np.flatnonzero(self.sides == 0)
        self.by_bucket = own[np.argsort(self.keys[own])]
        self.buckets = self.keys[self.by_bucket]
        rest = np.flatnonzero(self.sides > 0)
        self.at = {(s, k): i for i, s, k in zip(rest.tolist(), self.sides[rest].tolist(), self.keys[rest].tolist(), strict=True)}
        words = rows.filter(pc.equal(rows.column("side"), 3)).sort_by("key")
        self.word = {w: i for i, w in enumerate(words.column("word").to_pylist())}
        self.word_keys, self.n, self.keep = words.column("key").to_numpy(), words.column("n").to_numpy().astype(float), words.column("keep").to_numpy()
        self.parts = [self.local_inputs(p) for p in _each(words, "parts")]
        self.nodes = [np.array([self.at[1, x] for x in p.tolist()], np.int64) for p in _each(words, "nodes")]
        self.turns = _each(words, "turns")

    def local_inputs(self, buckets: np.ndarray) -> np.ndarray:
        return self.by_bucket[np.searchsorted(self.buckets, buckets)]

    def examples(self, docs: pa.Table, model: str, window: int, draw: np.random.Generator):
        """Rows of inputs and the local word that each is to predict; windows and discarded words are drawn anew."""
        for doc, words in zip(docs.column("doc").to_pylist(), docs.column("words").to_pylist(), strict=True):
            ids = np.array([self.word[w] for w in words if w in self.word], np.int64)
            ids = ids[draw.random(len(ids)) < self.keep[ids]]
            own = [self.at[2, doc]] if model.startswith("document") else []
            reach = draw.integers(1, window + 1, len(ids))
            for i, w in enumerate(ids):
                if model == "document":
                    yield np.array(own), w
                    continue
                near = [ids[j] for j in range(max(0, i - reach[i]), min(len(ids), i + reach[i] + 1)) if j != i]
                if model == "skipgram":
                    for x in near:
                        yield self.parts[w], x
                elif near or own:
                    around = np.concatenate([np.zeros(0, np.int64), *[self.parts[x] for x in near]])
                    yield np.concatenate([np.repeat(np.array(own, np.int64), max(1, len(around))), around]), w  # the document is half of the mean


def _padded(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    there = np.arange(max(map(len, lists)))[None, :] < np.array([len(x) for x in lists])[:, None]
    out = np.zeros(there.shape, np.int64)
    out[there] = np.concatenate(lists)
    return out, there


@dataclass(frozen=True)
class Settings:
    model: str | None = "skipgram"  # None: labelled documents
    loss: str = "negative"
    buckets: int = 1 << 21
    dim: int = 100
    window: int = 5
    negatives: int = 5
    epochs: int = 5
    rate: float = 0.1
    batch: int = 32
    seed: int = 7


def _learn(settings: Settings, rate: float, epoch: int, n_labels: int, passes: int = 1, frozen: bool = False):
    """One block's passes: ``side, key, vector`` of what it holds, and its loss and examples as side 4."""

    def learn(key, docs: pa.Table, rows: pa.Table) -> pa.Table:
        block = _Block(rows, settings.dim, settings.seed)
        draw = np.random.default_rng([settings.seed, epoch, key[0].as_py()])
        total, seen = 0.0, 0
        ladder = np.cumsum(np.sqrt(block.n)) if len(block.n) else None
        keys = np.array([block.at[1, k] for k in block.word_keys.tolist()]) if settings.model and settings.loss == "negative" else None
        labels = np.array([block.at[1, k] for k in range(n_labels)]) if n_labels and settings.loss != "hierarchical" else None
        before = block.table.copy() if frozen else None

        def step(some: list[np.ndarray], aim: list[int]) -> float:
            target = np.array(aim)
            if settings.loss == "hierarchical":
                outs, there = _padded([block.nodes[t] for t in aim])
                turns, _ = _padded([block.turns[t] for t in aim])
                return binary_step(block.table, block.table, some, outs, 1 - turns, there, rate, frozen)
            if settings.loss == "negative":
                pool, steps = (keys, ladder) if labels is None else (labels, np.arange(1.0, n_labels + 1))
                others = np.minimum(np.searchsorted(steps, draw.random((len(some), settings.negatives)) * steps[-1]), len(steps) - 1)
                wanted = np.zeros((len(some), settings.negatives + 1))
                wanted[:, 0] = 1
                there = np.concatenate([np.ones((len(some), 1), bool), others != target[:, None]], axis=1)  # a target is no negative of its own
                return binary_step(block.table, block.table, some, pool[np.concatenate([target[:, None], others], axis=1)], wanted, there, rate, frozen)
            own = block.table[labels]
            lost = whole_step(block.table, own, some, target, settings.loss, rate)
            block.table[labels] = own
            return lost

        for _ in range(passes):
            if settings.model:
                made = list(block.examples(docs, settings.model, settings.window, draw))
            else:
                made = [(block.local_inputs(x), t) for x, t in zip(_each(docs, "inputs"), docs.column("target").to_pylist(), strict=True) if len(x)]
            order = draw.permutation(len(made))
            for at in range(0, len(order), settings.batch):
                some = [made[i] for i in order[at : at + settings.batch]]
                total += step([x for x, _ in some], [int(t) for _, t in some])
                seen += len(some)
            if frozen:  # documents alone move
                block.table[block.sides != 2] = before[block.sides != 2]
        n = len(block.keys) if seen else 0
        bounds = np.append(np.arange(n + 1) * settings.dim, [n * settings.dim + 2] * bool(seen)).astype(np.int32)
        vectors = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.append(block.table[:n].ravel(), [total, float(seen)] * bool(seen))))
        return pa.table({"side": pa.array(np.append(block.sides[:n], [4] * bool(seen)), pa.int32()), "key": pa.array(np.append(block.keys[:n], [0] * bool(seen)), pa.int64()), "vector": vectors})

    return learn


_ROWS = "block long, side int, key long, vector array<double>, word string, n long, keep double, parts array<long>, nodes array<long>, turns array<int>"


def _aligned(df: DataFrame) -> DataFrame:
    """``df`` with all columns of ``_ROWS``."""
    kinds = [x.strip().split(" ", 1) for x in _ROWS.split(",")]
    return df.select(*[F.col(n).cast(t).alias(n) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in kinds])


@dataclass
class SubwordVectors:
    """Parameters as a table, words as a table, and the loss of an example in each epoch."""

    parameters: DataFrame
    settings: Settings
    words: DataFrame | None = None
    labels: list[str] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    def part_rows(self) -> DataFrame:
        """``bucket, vector``, as ``vector_of_word`` reads it."""
        return self.parameters.where("side = 0").select(F.col("key").alias("bucket"), "vector")

    def vectors_of(self, words: DataFrame, word_col: str = "word") -> DataFrame:
        """``word, vector`` of words, known or not: the mean over their subwords that were met."""
        parts = words.select(F.col(word_col).alias("word")).distinct().select("word", F.explode(subwords(F.col("word"), self.settings.buckets)).alias("bucket"))
        return parts.join(self.part_rows(), "bucket").groupBy("word").agg(_mean_vector(self.settings.dim))

    def document_vectors(self) -> DataFrame:
        """``doc, vector`` of the documents that were trained on, by the hash of their id."""
        return self.parameters.where("side = 2").select(F.col("key").alias("doc"), "vector")

    def predict(self, docs: DataFrame, word_ngrams: int = 2, id_col: str = "doc_id", words_col: str = "words") -> DataFrame:
        """``doc_id, predicted, score`` of every document; without any input that was met it has neither.

        Inputs meet their vectors in a join; the labels' vectors, a row a label, go to every task.
        """
        s = self.settings
        held = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("doc_id"), document_inputs(F.col(words_col), s.buckets, word_ngrams).alias("_inputs"))
        each = held.select("_row", F.explode("_inputs").alias("key")).groupBy("_row", "key").agg(F.count("*").alias("n"))
        met = each.join(self.parameters.where("side = 0").select("key", "vector"), "key")
        hidden = met.groupBy("_row").agg(F.array(*[F.sum(F.col("n") * F.get("vector", F.lit(i))) / F.sum("n") for i in range(s.dim)]).alias("h"))
        outputs = {r["key"]: np.array(r["vector"]) for r in self.parameters.where("side = 1").collect()}  # a row a label, or a tree's node
        names, paths = self.labels, None
        if s.loss == "hierarchical":
            paths = {r["key"]: (list(r["nodes"]), list(r["turns"])) for r in self.words.collect()}

        @F.pandas_udf("predicted string, score double")
        def best(hidden: pd.Series) -> pd.DataFrame:
            out = []
            for h in hidden:
                if h is None:
                    out.append((None, None))
                elif paths is not None:
                    p = [np.prod([_sigmoid((1 - 2 * t) * (outputs[n] @ h)) for n, t in zip(*paths[k], strict=True)]) if k in paths else 0.0 for k in range(len(names))]
                    out.append((names[int(np.argmax(p))], float(np.max(p))))
                else:
                    score = np.stack([outputs[k] for k in range(len(names))]) @ h
                    p = np.exp(score - score.max())
                    out.append((names[int(score.argmax())], float(p.max() / p.sum())))
            return pd.DataFrame(out, columns=["predicted", "score"])

        return held.select("_row", "doc_id").join(hidden, "_row", "left").select("doc_id", best("h").alias("_b")).select("doc_id", "_b.*")

    def infer_documents(self, docs: DataFrame, passes: int = 20, id_col: str = "doc_id", words_col: str = "words") -> DataFrame:
        """``doc, vector`` of documents, seen or not, by the hash of their id: only their own vectors are trained."""
        with Scope(docs.sparkSession) as scope:
            blocks, rows = _of_words(scope, docs, self.words, self.settings, id_col, words_col)
            met = _with_vectors(rows, self.parameters.where("side < 2"))
            made = _cogrouped(blocks, met, _learn(self.settings, self.settings.rate, 0, 0, passes, True)).where("side = 2")
            return scope.keep(scope.write(made.select(F.col("key").alias("doc"), "vector"), "document-vectors"))


def _mean_vector(dim: int) -> Column:
    return F.array(*[F.avg(F.get("vector", F.lit(i))) for i in range(dim)]).alias("vector")


def _cogrouped(docs: DataFrame, rows: DataFrame, learn) -> DataFrame:
    return docs.groupBy("block").cogroup(rows.groupBy("block")).applyInArrow(learn, PARAMETERS)


def _with_vectors(rows: DataFrame, parameters: DataFrame) -> DataFrame:
    """The rows of blocks, with the vectors of those that have one."""
    needed = rows.where("side < 3").select("block", "side", "key")
    return _aligned(needed.join(parameters, ["side", "key"], "left")).unionByName(rows.where("side = 3"))


def _blocks(scope: Scope, docs: DataFrame, size: Column) -> DataFrame:
    """``docs`` with ``block``: documents by hash, in blocks of some ``BLOCK_WORDS``."""
    total = docs.agg(F.sum(size)).first()[0] or 0
    n = max(1, -(-int(total) // BLOCK_WORDS))
    return scope.write(docs.withColumn("block", F.pmod(F.xxhash64("doc", F.lit(1)), F.lit(n)).cast("long")), "blocks")


def _of_words(scope: Scope, docs: DataFrame, words: DataFrame, settings: Settings, id_col: str, words_col: str) -> tuple[DataFrame, DataFrame]:
    """Blocks of documents, and for each block its words and the keys of the vectors that it needs."""
    blocks = _blocks(scope, docs.select(F.xxhash64(id_col).alias("doc"), F.coalesce(F.col(words_col), F.array().cast("array<string>")).alias("words")), F.size("words"))
    met = scope.write(blocks.select("block", F.explode("words").alias("word")).distinct().join(words, "word"), "block-words")
    parts = met.select("block", F.lit(0).alias("side"), F.explode("parts").alias("key"))
    outs = met.select("block", F.lit(1).alias("side"), F.explode("nodes").alias("key") if settings.loss == "hierarchical" else F.col("key"))
    needed = parts.unionByName(outs)
    if settings.model.startswith("document"):
        needed = needed.unionByName(blocks.select("block", F.lit(2).alias("side"), F.col("doc").alias("key")))
    return blocks, scope.write(_aligned(needed.distinct()).unionByName(_aligned(met.withColumn("side", F.lit(3)))), "block-needs")


def _epochs(scope: Scope, blocks: DataFrame, rows: DataFrame, settings: Settings, n_labels: int) -> tuple[DataFrame, list[float]]:
    spark = blocks.sparkSession
    parameters, losses = spark.createDataFrame([], PARAMETERS), []
    for epoch in range(settings.epochs):
        rate = settings.rate * (1 - epoch / settings.epochs)
        moved = scope.write(_cogrouped(blocks, _with_vectors(rows, parameters), _learn(settings, rate, epoch, n_labels)), "moved")
        lost = moved.where("side = 4").agg(F.sum(F.get("vector", F.lit(0))), F.sum(F.get("vector", F.lit(1)))).first()
        if not lost[1]:
            break
        losses.append(lost[0] / lost[1])
        after = scope.write(moved.where("side < 3").groupBy("side", "key").agg(_mean_vector(settings.dim)), "parameters")
        scope.discard(moved)
        if losses[1:]:
            scope.discard(parameters)
        parameters = after
    return scope.keep(parameters), losses


def fit_vectors(docs: DataFrame, model: str = "skipgram", loss: str = "negative", min_count: int = 1, threshold: float = 1e-4, words_col: str = "words", id_col: str = "doc_id", **options) -> SubwordVectors:
    """Vectors of words and, with the models of documents, of documents too; ``options`` are those of ``Settings``.

    Words under ``min_count`` are left out, and occurrences of frequent ones by chance (``threshold``; ``None`` keeps
    all). Windows are drawn from 1 to ``window`` words on either side. Negatives are drawn from a block's words, by the
    root of their count in the corpus; a tree is made of all counts. Documents of one id share a vector. Null words and
    documents without any are passed over; an empty table gives empty tables.
    """
    settings = Settings(model=model, loss=loss, **options)
    if model not in MODELS or loss not in LOSSES[:2]:
        raise ValueError(f"no model {model} with loss {loss}")
    spark = docs.sparkSession
    with Scope(spark) as scope:
        words = scope.write(vocabulary(docs, min_count, threshold if threshold is not None else 1e9, settings.buckets, words_col), "vocabulary")
        if loss == "hierarchical":
            words = scope.write(words.join(_paths(spark, words), "key"), "vocabulary")
        else:
            words = words.withColumns({"nodes": F.lit(None).cast("array<long>"), "turns": F.lit(None).cast("array<int>")})
        blocks, rows = _of_words(scope, docs, words, settings, id_col, words_col)
        parameters, losses = _epochs(scope, blocks, rows, settings, 0)
        return SubwordVectors(parameters, settings, scope.keep(words), [], losses)


def fit_classifier(docs: DataFrame, labels: list[str], loss: str = "softmax", word_ngrams: int = 2, words_col: str = "words", label_col: str = "label", id_col: str = "doc_id", **options) -> SubwordVectors:
    """A classifier of documents over words, subwords and word n-grams; ``labels`` bounds what is predicted.

    With the loss ``hierarchical`` a step costs the length of a label's path, not the number of labels. Documents of
    other labels, and without any, aren't learned from.
    """
    settings = Settings(model=None, loss=loss, **{"dim": 32, **options})
    if loss not in LOSSES:
        raise ValueError(f"no loss {loss}")
    spark = docs.sparkSession
    place = (F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label_col)) - 1).alias("target")
    with Scope(spark) as scope:
        known = docs.where(F.col(label_col).isin(labels)).select(F.xxhash64(id_col).alias("doc"), F.coalesce(document_inputs(F.col(words_col), settings.buckets, word_ngrams), F.array().cast("array<long>")).alias("inputs"), place)
        blocks = _blocks(scope, known, F.size("inputs"))
        needed = blocks.select("block", F.lit(0).alias("side"), F.explode("inputs").alias("key")).distinct()
        if loss == "hierarchical":
            counted = blocks.groupBy(F.col("target").alias("key")).agg(F.count("*").alias("n"))
            met = {r["key"]: r["n"] for r in counted.collect()}  # a row a label
            all_ = spark.createDataFrame([(k, met.get(k, 0)) for k in range(len(labels))], "key long, n long")
            words = scope.write(_paths(spark, all_).select("key", "nodes", "turns", F.lit("").alias("word"), F.lit(1.0).alias("keep"), F.lit(1).cast("long").alias("n"), F.array().cast("array<long>").alias("parts")), "labels")
            each = blocks.select("block").distinct().join(F.broadcast(words.withColumn("side", F.lit(3))))  # the labels' rows, to each block
            outs = each.select("block", F.lit(1).alias("side"), F.explode("nodes").alias("key")).distinct()
            rows = _aligned(needed.unionByName(outs)).unionByName(_aligned(each))
        else:
            words = None
            outs = blocks.select("block").distinct().select("block", F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(len(labels) - 1).cast("long"))).alias("key"))
            rows = _aligned(needed.unionByName(outs))
        rows = scope.write(rows, "block-needs")
        parameters, losses = _epochs(scope, blocks, rows, settings, len(labels))
        return SubwordVectors(parameters, settings, scope.keep(words) if words is not None else None, list(labels), losses)


def tuned_classifier(docs: DataFrame, labels: list[str], trials: int = 6, held_share: float = 0.2, seed: int = 7, words_col: str = "words", label_col: str = "label", id_col: str = "doc_id", **fixed) -> tuple[SubwordVectors, list[tuple[float, dict]]]:
    """The best of ``trials`` classifiers by accuracy on documents held back, and what was tried.

    The first trial has the defaults; each later one draws rate, dimension, epochs and word n-grams about the best so
    far, from a seeded normal distribution on a scale of logarithms that narrows with the trials.
    """
    draw = np.random.default_rng(seed)
    back = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1000)) < int(1000 * held_share)
    train, held = docs.where(~back), docs.where(back & F.col(label_col).isin(labels))
    best, tried = None, []
    at = {"rate": 0.1, "dim": 16, "epochs": 5, "word_ngrams": 2}
    for k in range(trials):
        width = 0.5 * (1 - k / trials)
        options = dict(at) if k == 0 else {"rate": float(at["rate"] * np.exp(draw.normal(0, 2 * width))), "dim": int(np.clip(round(at["dim"] * np.exp(draw.normal(0, width))), 4, 300)), "epochs": int(np.clip(round(at["epochs"] * np.exp(draw.normal(0, width))), 1, 50)), "word_ngrams": int(np.clip(round(at["word_ngrams"] + draw.normal(0, 2 * width)), 1, 5))}
        model = fit_classifier(train, labels, words_col=words_col, label_col=label_col, id_col=id_col, seed=seed, **{**options, **fixed})
        got = model.predict(held, options["word_ngrams"], id_col, words_col).join(held.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("_label")), "doc_id")
        score = got.agg(F.avg((F.col("predicted") == F.col("_label")).cast("double"))).first()[0] or 0.0
        tried.append((score, options))
        if best is None or score > best[0]:
            best, at = (score, model), options
    return best[1], tried
