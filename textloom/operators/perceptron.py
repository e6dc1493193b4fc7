"""Averaged perceptrons trained by parameter mixing: each partition learns alone for an epoch, weights are averaged."""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass, field
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Weights:
    """Weight of each feature and label."""

    labels: list[str] = field(default_factory=list)
    by_feature: dict[str, dict[str, float]] = field(default_factory=dict)

    def scores(self, features) -> dict[str, float]:
        out = dict.fromkeys(self.labels, 0.0)
        for f in features:
            for label, w in self.by_feature.get(f, {}).items():
                out[label] += w
        return out

    def best(self, features, allowed=None) -> str:
        scores = self.scores(features)
        return max(allowed or self.labels, key=lambda x: (scores.get(x, 0.0), x))

    def as_dict(self) -> dict:
        return {"labels": self.labels, "by_feature": self.by_feature}

    @staticmethod
    def from_dict(made: dict) -> Weights:
        return Weights(made["labels"], made["by_feature"])

    def to_rows(self, spark) -> DataFrame:
        """``feature, label, weight``, to be written as a table; a row without a feature for each label."""
        each = [("", label, 0.0) for label in self.labels] + [(f, label, float(w)) for f, ws in self.by_feature.items() for label, w in ws.items()]
        return spark.createDataFrame(each, "feature string, label string, weight double")

    @staticmethod
    def from_rows(rows: DataFrame) -> Weights:
        made = Weights()
        for r in rows.collect():
            if r.feature:
                made.by_feature.setdefault(r.feature, {})[r.label] = r.weight
            else:
                made.labels.append(r.label)
        made.labels = sorted({*made.labels, *(label for ws in made.by_feature.values() for label in ws)})
        return made


def fit_perceptron(examples: DataFrame, epochs: int = 5, max_features: int = 2_000_000, seed: int = 7, max_labels: int = 20_000) -> Weights:
    """Fit on rows of ``features`` (array of strings) and ``label``.

    An epoch is one pass in every partition and one average over partitions; features beyond ``max_features``, the
    least heavy first, are dropped when weights come together, which bounds what is sent to the executors. More labels
    than ``max_labels`` are an error.
    """
    examples = examples.persist()
    labels = sorted(r.label for r in examples.select("label").distinct().limit(max_labels + 1).collect())
    if len(labels) > max_labels:
        raise ValueError(f"more than {max_labels} labels")
    model = Weights(labels)
    for epoch in range(epochs):
        made = model.as_dict()

        def learn(batches, made=made, epoch=epoch):
            import random

            own = Weights(made["labels"], {f: dict(w) for f, w in made["by_feature"].items()})
            total: dict[tuple[str, str], float] = {}
            steps = 0
            for pdf in batches:
                rows = list(zip(pdf["features"], pdf["label"], strict=True))
                random.Random(seed + epoch).shuffle(rows)
                for features, label in rows:
                    steps += 1
                    guess = own.best(features)
                    if guess != label:
                        for f in features:
                            ws = own.by_feature.setdefault(f, {})
                            ws[label] = ws.get(label, 0.0) + 1
                            ws[guess] = ws.get(guess, 0.0) - 1
                            total[f, label] = total.get((f, label), 0.0) + steps
                            total[f, guess] = total.get((f, guess), 0.0) - steps
            if steps:
                rows = [(f, label, w - total.get((f, label), 0.0) / (steps + 1)) for f, ws in own.by_feature.items() for label, w in ws.items()]
                yield pd.DataFrame([*rows, ("", "", float(1))], columns=["feature", "label", "weight"])

        mixed = examples.mapInPandas(learn, "feature string, label string, weight double").groupBy("feature", "label").agg(F.sum("weight").alias("weight"))
        kept = mixed.orderBy(F.col("feature") != "", F.desc(F.abs("weight"))).limit(max_features).collect()
        parts = next((r.weight for r in kept if r.feature == ""), 1.0)
        model = Weights(labels)
        for r in kept:
            if r.feature and r.weight:
                model.by_feature.setdefault(r.feature, {})[r.label] = r.weight / parts
    examples.unpersist()
    return model


def token_features(words: list[str], at: int, before: str, before2: str, known: list | None = None) -> list[str]:
    """What a tagger knows about a word: itself, its ends, its look, its neighbours and the last two tags; with ``known``
    also the kinds of dictionary entry that it and its neighbours are in (as ``spot.known_types`` gives them)."""
    get = lambda k: words[k].lower() if 0 <= k < len(words) else "<s>" if k < 0 else "</s>"
    w = words[at]
    look = "number" if any(c.isdigit() for c in w) else "upper" if w.isupper() else "title" if w[:1].isupper() else "hyphen" if "-" in w else "lower"
    listed = [f"g{k:+d}={kind}" for k in (-1, 0, 1) if known and 0 <= at + k < len(known) for kind in (known[at + k] if known[at + k] is not None else ())]
    return listed + ["bias", f"w={w.lower()}", f"s3={w[-3:].lower()}", f"s2={w[-2:].lower()}", f"p1={w[:1]}", f"look={look}", f"t1={before}", f"t2={before2}|{before}", f"t1w={before}|{w.lower()}", f"w-1={get(at - 1)}", f"w-2={get(at - 2)}", f"w+1={get(at + 1)}", f"w+2={get(at + 2)}", f"s-1={get(at - 1)[-3:]}", f"s+1={get(at + 1)[-3:]}"]


def _follows(tag: str, before: str) -> bool:
    """Whether a B/I/L/O/U tag may come after another."""
    inside = before[:1] in ("B", "I")
    return (tag[:1] in ("I", "L") and tag[1:] == before[1:]) if inside else tag[:1] not in ("I", "L")


def fit_tagger(sentences: DataFrame, words_col: str = "words", tags_col: str = "tags", epochs: int = 5, seed: int = 7, known_col: str | None = None) -> Weights:
    """Fit a tagger (parts of speech, or entities as B/I/L/O/U tags) on arrays of words and their tags, and of the
    dictionary's kinds of each word (``known_col``) if there are any."""

    def examples(batches):
        for pdf in batches:
            rows = []
            for words, tags, known in zip(pdf["w"], pdf["t"], pdf["k"], strict=True):
                tags, known = list(tags), list(known) if known is not None else None
                rows += [(token_features(list(words), k, tags[k - 1] if k else "<s>", tags[k - 2] if k > 1 else "<s>", known), tags[k]) for k in range(len(tags))]
            yield pd.DataFrame(rows, columns=["features", "label"])

    return fit_perceptron(sentences.select(F.col(words_col).alias("w"), F.col(tags_col).alias("t"), _known(known_col).alias("k")).mapInPandas(examples, "features array<string>, label string"), epochs, seed=seed)


def _known(column: str | None):
    return F.col(column) if column else F.lit(None).cast("array<array<string>>")


def tag_words(words: list[str], scorer: Weights, single: dict[str, str], entities: bool, known: list | None = None) -> list[str]:
    got: list[str] = []
    for k, w in enumerate(words):
        before, before2 = got[-1] if k else "<s>", got[-2] if k > 1 else "<s>"
        allowed = [t for t in scorer.labels if _follows(t, before if k else "O")] if entities else None
        got.append(single.get(w.lower()) or scorer.best(token_features(words, k, before, before2, known), allowed))
    if entities and got and got[-1][:1] in ("B", "I"):
        got[-1] = ("U" if got[-1][0] == "B" else "L") + got[-1][1:]
    return got


def tag(df: DataFrame, model: Weights, words_col: str = "words", into: str = "tags", single: dict[str, str] | None = None, entities: bool = False, known_col: str | None = None) -> DataFrame:
    """``df`` with a tag for each word, from left to right. single: words with only one tag. entities: only B/I/L/O/U
    sequences that make sense; a run that the text's end cuts off is closed."""
    made, single = model.as_dict(), single or {}

    @F.pandas_udf("array<string>")
    def tags(words: pd.Series, known: pd.Series) -> pd.Series:
        scorer = Weights.from_dict(made)
        return pd.Series([tag_words(list(row) if row is not None else [], scorer, single, entities, list(k) if k is not None else None) for row, k in zip(words, known, strict=True)])

    return df.withColumn(into, tags(F.col(words_col), _known(known_col)))


def _moves(stack: list[int], left: int) -> list[str]:
    return [m for m, ok in (("shift", left > 0), ("left", len(stack) > 2 or len(stack) == 2 and stack[0] != -1), ("right", len(stack) > 1)) if ok]


def _arc_features(words: list[str], tags: list[str], stack: list[int], at: int) -> list[str]:
    w = lambda k: "<root>" if k == -1 else words[k].lower() if 0 <= k < len(words) else "</s>"
    t = lambda k: "<root>" if k == -1 else tags[k] if 0 <= k < len(tags) else "</s>"
    s0, s1 = stack[-1], stack[-2] if len(stack) > 1 else -1
    far = min(5, s0 - s1)
    return ["bias", f"s0={w(s0)}", f"s1={w(s1)}", f"n0={w(at)}", f"ts0={t(s0)}", f"ts1={t(s1)}", f"tn0={t(at)}", f"tn1={t(at + 1)}", f"tt={t(s1)}|{t(s0)}", f"ttn={t(s1)}|{t(s0)}|{t(at)}", f"ww={w(s1)}|{w(s0)}", f"wt={w(s1)}|{t(s0)}", f"tw={t(s1)}|{w(s0)}", f"far={far}|{t(s1)}|{t(s0)}"]


def parse_arcs(words: list[str], tags: list[str], choose) -> list[int]:
    """Heads by arc-standard moves (-1 for the root); ``choose(features, allowed, stack, at)`` names each move."""
    heads, stack, at = [-1] * len(words), [-1], 0
    while at < len(words) or len(stack) > 1:
        if len(stack) == 1:
            stack.append(at)
            at += 1
            continue
        allowed = _moves(stack, len(words) - at)
        move = choose(_arc_features(words, tags, stack, at), allowed, stack, at)
        if move == "shift":
            stack.append(at)
            at += 1
        elif move == "left":
            heads[stack.pop(-2)] = stack[-1]
        else:
            low = stack.pop()
            heads[low] = stack[-1]
    return heads


def gold_moves(words: list[str], tags: list[str], heads: list[int]) -> list[tuple[list[str], str]]:
    """Features and moves that make a tree's arcs (a projective one's exactly)."""
    out, done = [], [False] * len(words)

    def choose(features, allowed, stack, at):
        s0, s1 = stack[-1], stack[-2]
        rest = [k for k in range(len(words)) if heads[k] == s0 and not done[k]]
        move = "shift"
        if "left" in allowed and s1 != -1 and heads[s1] == s0:
            move = "left"
            done[s1] = True
        elif heads[s0] == s1 and not rest or "shift" not in allowed:
            move = "right"
            done[s0] = True
        out.append((features, move))
        return move

    parse_arcs(words, tags, choose)
    return out


def fit_parser(sentences: DataFrame, epochs: int = 5, seed: int = 7) -> Weights:
    """Fit a dependency parser on ``words, tags, heads`` (positions from 0, -1 for the root)."""

    def examples(batches):
        for pdf in batches:
            rows = [x for w, t, h in zip(pdf["words"], pdf["tags"], pdf["heads"], strict=True) for x in gold_moves(list(w), list(t), list(h))]
            yield pd.DataFrame(rows, columns=["features", "label"])

    return fit_perceptron(sentences.select("words", "tags", "heads").mapInPandas(examples, "features array<string>, label string"), epochs, seed=seed)


def parse(df: DataFrame, model: Weights, into: str = "heads") -> DataFrame:
    made = model.as_dict()

    @F.pandas_udf("array<int>")
    def heads(words: pd.Series, tags: pd.Series) -> pd.Series:
        scorer = Weights.from_dict(made)
        return pd.Series([parse_arcs(list(w), list(t), lambda f, allowed, stack, at: scorer.best(f, allowed)) for w, t in zip(words, tags, strict=True)])

    return df.withColumn(into, heads("words", "tags"))


def _sentence_starts(token_begins, span_begins) -> list[int]:
    """The first token of each sentence; all tokens are one sentence where there are no spans."""
    begins = list(token_begins)
    return [0, *sorted({bisect_left(begins, b) for b in (span_begins if span_begins is not None else ())} - {0, len(begins)})] if begins else []


def tag_documents(df: DataFrame, model: Weights, into: str = "tags", single: dict[str, str] | None = None, entities: bool = False, known_col: str | None = None) -> DataFrame:
    """``df`` with a tag for each of its ``tokens``, sentence by sentence where it has ``spans``; null tokens give null.
    ``known_col`` has the dictionary's kinds of each token, if the model was fitted with them."""
    made, single = model.as_dict(), single or {}

    @F.pandas_udf("array<string>")
    def tags(words: pd.Series, begins: pd.Series, spans: pd.Series, known: pd.Series) -> pd.Series:
        scorer = Weights.from_dict(made)
        out = []
        for row, at, starts, kinds in zip(words, begins, spans, known, strict=True):
            if row is None:
                out.append(None)
                continue
            row, got = list(row), []
            firsts = _sentence_starts(at, starts)
            for a, b in pairwise([*firsts, len(row)]):
                got += tag_words(row[a:b], scorer, single, entities, list(kinds)[a:b] if kinds is not None else None)
            out.append(got)
        return pd.Series(out)

    spans = F.transform("spans", lambda s: s["begin"]) if "spans" in df.columns else F.lit(None).cast("array<int>")
    return df.withColumn(into, tags(F.transform("tokens", lambda t: t["value"]), F.transform("tokens", lambda t: t["begin"]), spans, _known(known_col)))


def parse_documents(df: DataFrame, model: Weights, into: str = "heads") -> DataFrame:
    """``df`` with the head of each of its ``tokens`` (its place in the document, -1 for a root), sentence by sentence."""
    made = model.as_dict()

    @F.pandas_udf("array<int>")
    def heads(words: pd.Series, tags: pd.Series, begins: pd.Series, spans: pd.Series) -> pd.Series:
        scorer = Weights.from_dict(made)
        out = []
        for w, t, at, starts in zip(words, tags, begins, spans, strict=True):
            if w is None or t is None:
                out.append(None)
                continue
            got, firsts = [], _sentence_starts(at, starts)
            for a, b in pairwise([*firsts, len(w)]):
                own = parse_arcs(list(w[a:b]), list(t[a:b]), lambda f, allowed, stack, k: scorer.best(f, allowed))
                got += [h + a if h >= 0 else -1 for h in own]
            out.append(got)
        return pd.Series(out)

    spans = F.transform("spans", lambda s: s["begin"]) if "spans" in df.columns else F.lit(None).cast("array<int>")
    return df.withColumn(into, heads(F.transform("tokens", lambda t: t["value"]), "tags", F.transform("tokens", lambda t: t["begin"]), spans))


def tag_scores(df: DataFrame, gold: str = "gold", tags: str = "tags") -> DataFrame:
    """``tag, correct, predicted, actual, precision, recall, f1`` of each tag, and with a null tag the accuracy over all tokens."""
    pairs = df.select(F.explode(F.arrays_zip(F.col(gold).alias("g"), F.col(tags).alias("t"))).alias("_p")).select("_p.g", "_p.t")
    each = pairs.select(F.explode(F.array(F.struct(F.col("g").alias("tag"), F.lit(1).alias("a"), F.lit(0).alias("p"), (F.col("g") == F.col("t")).cast("int").alias("c")), F.struct(F.col("t").alias("tag"), F.lit(0).alias("a"), F.lit(1).alias("p"), F.lit(0).alias("c")))).alias("_e")).select("_e.*").where("tag is not null")
    sums = each.rollup("tag").agg(F.sum(F.coalesce("c", F.lit(0))).alias("correct"), F.sum("p").alias("predicted"), F.sum("a").alias("actual"))
    precision, recall = F.try_divide("correct", "predicted"), F.try_divide("correct", "actual")
    return sums.select("tag", "correct", "predicted", "actual", precision.alias("precision"), recall.alias("recall"), F.try_divide(2 * F.col("correct"), F.col("predicted") + F.col("actual")).alias("f1"))


def attachment_scores(df: DataFrame, gold: str = "gold", heads: str = "heads") -> DataFrame:
    """``n_tokens, attached, n_roots, right_roots, unlabelled, root_accuracy`` over all sentences, in one pass."""
    pairs = df.select(F.explode(F.arrays_zip(F.col(gold).alias("g"), F.col(heads).alias("h"))).alias("_p")).select("_p.g", "_p.h")
    sums = pairs.agg(F.count("*").alias("n_tokens"), F.sum((F.col("g") == F.col("h")).cast("long")).alias("attached"), F.sum((F.col("g") == -1).cast("long")).alias("n_roots"), F.sum(((F.col("g") == -1) & (F.col("h") == -1)).cast("long")).alias("right_roots"))
    return sums.select("*", F.try_divide("attached", "n_tokens").alias("unlabelled"), F.try_divide("right_roots", "n_roots").alias("root_accuracy"))


def is_verb_root(df: DataFrame, tags: str = "tags", heads: str = "heads") -> DataFrame:
    """``df`` with whether the root of the sentence is a verb."""
    return df.withColumn("verb_root", F.coalesce(F.get(tags, F.array_position(heads, -1).cast("int") - 1) == "VERB", F.lit(False)))


def is_projective(df: DataFrame, heads: str = "heads") -> DataFrame:
    """``df`` with whether no two arcs cross."""
    h = F.col(heads)
    low, high = (lambda i: F.least(i, F.get(h, i))), (lambda i: F.greatest(i, F.get(h, i)))
    at = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1)).otherwise(F.array().cast("array<int>"))
    crosses = lambda i, j: (low(i) < low(j)) & (low(j) < high(i)) & (high(i) < high(j))
    return df.withColumn("projective", ~F.exists(at, lambda i: F.exists(at, lambda j: (F.get(h, i) >= 0) & (F.get(h, j) >= 0) & crosses(i, j))))
