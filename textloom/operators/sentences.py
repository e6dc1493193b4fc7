"""Sentences: a rule in built-in expressions, and an averaged perceptron over the context of each mark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.perceptron import Weights, fit_perceptron
from textloom.operators.tokenize import Tokenizer, exceptions_for
from textloom.schema import SPAN

MARKS = frozenset("…:;!?.")
_ABBREVIATIONS = "Dr|Mr|Mrs|Ms|Prof|St|Jr|Sr|vs|etc|e\\.g|i\\.e|No|Nr|Co|Inc|Ltd|M|Mme|z\\.B|Sra"


def sentence_texts(text: Column) -> Column:
    """Sentences by rule: a mark, white space, and something that isn't lower case ends one, as does a line end."""
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), rf"(?<!\b(?:{_ABBREVIATIONS}))([.!?…]+[\"'”’)\]]*)\s+(?=[^\p{{Ll}}\s])|\n+", "$1\x02")
    return F.filter(F.transform(F.split(marked, "\x02"), lambda s: F.trim(s)), lambda s: s != "")


def spans_of_tokens(tokens: Column) -> Column:
    """``array<struct<ix, begin, end>>`` by rule, of tokens: one that ends in a mark, perhaps with closing quotes, ends a
    sentence if the next doesn't begin in lower case; the last token ends one. Null tokens give null."""
    n = F.size(tokens)
    value = lambda k: F.get(tokens, k)["value"]
    ends = F.filter(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), lambda k: (k == n - 1) | value(k).rlike("[.!?…][\"'”’)\\]]*$") & ~value(k + 1).rlike(r"^\p{Ll}"))
    made = lambda e: F.transform(e, lambda k, i: F.struct(i.alias("ix"), F.get(tokens, F.coalesce(F.get(e, i - 1) + 1, F.lit(0)))["begin"].alias("begin"), F.get(tokens, k)["end"].alias("end")))
    return F.when(tokens.isNotNull(), F.get(F.transform(F.array(ends), made), F.lit(0)))


def is_mark(value: str) -> bool:
    return bool(value) and all(c in MARKS for c in value)


def _looks(v: str) -> str:
    return "none" if not v else "upper" if v.isupper() else "title" if v[:1].isupper() else "lower" if v.islower() else "number" if v.isdigit() else "mark" if is_mark(v) else "other"


def mark_features(values: list[str], at: int) -> list[str]:
    """What is known about the mark at a place: it, its neighbours, how they look, and their lengths."""
    get = lambda k: values[k] if 0 <= k < len(values) else ""
    near = {k: get(at + k) for k in (-2, -1, 1, 2)}
    out = ["bias", f"mark={values[at]}"]
    for k, v in near.items():
        out += [f"look{k}={_looks(v)}", f"first{k}={v[:1]}", f"size{k}={min(len(v), 12)}", f"same{k}={v == values[at]}"]
    out += [f"pair={_looks(near[-1])}|{_looks(near[1])}", f"open={near[1][:1] in '\"“«(['}", f"before={near[-1].lower()}"]
    return out


def fit_sentence_model(sentences: DataFrame, text_col: str = "sentence", epochs: int = 5, lang: str | None = "en", seed: int = 7) -> Weights:
    """Learn where sentences end from rows of one sentence each; a mark at a row's end is an end, one inside isn't."""
    exceptions = exceptions_for(lang)

    def examples(batches):
        tokenizer = Tokenizer(exceptions)
        for pdf in batches:
            rows = []
            texts = [t for t in pdf["text"] if t]
            for text, after in zip(texts, [*texts[1:], ""], strict=True):
                values = [v for _, _, v, _ in tokenizer.cut(text)]
                joined = values + [v for _, _, v, _ in tokenizer.cut(after)]
                rows += [(mark_features(joined, k), "end" if k == len(values) - 1 else "inside") for k in range(1, len(values)) if is_mark(values[k])]
            yield pd.DataFrame(rows, columns=["features", "label"])

    return fit_perceptron(sentences.select(F.col(text_col).alias("text")).mapInPandas(examples, "features array<string>, label string"), epochs=epochs, seed=seed)


def sentence_spans(text: Column, model: Weights, lang: str | None = "en") -> Column:
    """``array<struct<ix, begin, end>>`` by the model. The first and the last token never end a sentence by themselves."""
    exceptions = exceptions_for(lang)
    weights = model.as_dict()

    @F.pandas_udf(f"array<{SPAN}>")
    def spans(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer, scorer = Tokenizer(exceptions), Weights.from_dict(weights)
        for texts in batches:
            out = []
            for text in texts:
                tokens = tokenizer.cut(text or "")
                values = [t[2] for t in tokens]
                found, start = [], 0
                for k in range(len(tokens)):
                    last = k == len(tokens) - 1
                    if last or k and is_mark(values[k]) and scorer.best(mark_features(values, k)) == "end":
                        found.append({"ix": len(found), "begin": tokens[start][0], "end": tokens[k][1] - 1})
                        start = k + 1
                out.append(found)
            yield pd.Series(out)

    return spans(text)
