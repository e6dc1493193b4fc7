"""Alignment of parts, as a model wrote them, to the text that they come from."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _table(a: str, b: str) -> np.ndarray:
    """Edit distances of all beginnings of two strings."""
    x, y = np.array([ord(c) for c in a]), np.array([ord(c) for c in b])
    d = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    d[0], d[:, 0] = np.arange(len(b) + 1), np.arange(len(a) + 1)
    place = np.arange(len(b) + 1)
    for i in range(1, len(a) + 1):
        row = np.minimum(d[i - 1, 1:] + 1, d[i - 1, :-1] + (y != x[i - 1]))
        d[i] = np.minimum.accumulate(np.concatenate([[i], row]) - place) + place
    return d


def realigned(text: str, parts: list[str], limit: float = 0.5) -> list[str] | None:
    """Slices of ``text``, one a part, that together are the text; None if the parts are too far from it.

    White space and case don't count. Far is an edit distance over ``limit`` of the longer side.
    """
    if not parts:
        return [text]
    if not text:
        return []
    kept = [i for i, c in enumerate(text) if not c.isspace()]
    own = "".join(text[i].lower()[:1] for i in kept)
    made, starts = "", []
    for part in parts:
        starts.append(len(made))
        made += "".join(c.lower()[:1] for c in part if not c.isspace())
    d = _table(own, made)
    if d[-1, -1] > limit * max(len(own), len(made), 1):
        return None
    at = {}
    i, j = len(own), len(made)
    while i or j:
        at[j] = i
        if i and j and d[i, j] == d[i - 1, j - 1] + (own[i - 1] != made[j - 1]):
            i, j = i - 1, j - 1
        elif j and d[i, j] == d[i, j - 1] + 1:
            j -= 1
        else:
            i -= 1
    at[0] = 0
    cuts = [0]
    for s in starts[1:]:
        i = at.get(s, len(own))
        cuts.append(max(cuts[-1], kept[i] if i < len(kept) else len(text)))
    cuts.append(len(text))
    return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def realign(text: Column, parts: Column, limit: float = 0.5) -> Column:
    """``array<string>`` of slices, null where the parts are rejected."""

    @F.pandas_udf("array<string>")
    def align(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, lists in batches:
            yield pd.Series([realigned(t or "", list(p) if p is not None else [], limit) for t, p in zip(texts, lists, strict=True)])

    return align(text, parts)
