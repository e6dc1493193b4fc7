"""Language ID: the languages of a text as a mixture, by expectation-maximisation over n-gram likelihoods.

Each word's likelihood under a language is the product of its byte trigrams' probabilities (with a blank on either
side). A text is a mixture of languages with unknown shares; EM finds the shares, and the set of languages is the one
of the least penalised likelihood -2 log L + (languages - 1) log(words) among those met on the way from all to one.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import held_out

GRAMS = 1 << 16
#: Bytes handled at once; a longer text is read in pieces of this size.
PIECE = 1 << 21
_LETTER = re.compile(r"[^\W\d_]")
_WORD_BYTES = np.full(256, 32, np.uint8)
_WORD_BYTES[97:123] = np.arange(97, 123)
_WORD_BYTES[128:] = np.arange(128, 256)


def _pieces(text: str, size: int) -> list[bytes]:
    data = text.lower().encode("utf-8", "surrogatepass")
    out = []
    while len(data) > size:
        cut = data.rfind(b" ", size // 2, size)
        cut = cut if cut > 0 else size
        out.append(data[:cut])
        data = data[cut:]
    return [*out, data]


def _grams(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram of each word byte, where words start among them, and the piece of each word."""
    joined = np.frombuffer(b" " + b" ".join(pieces) + b" ", np.uint8)
    data = _WORD_BYTES[joined].astype(np.uint32)
    at = np.flatnonzero(data != 32)
    before, here, after = data[at - 1], data[at], data[at + 1]
    gram = (((before << 16) | (here << 8) | after) * np.uint32(2654435761)) >> np.uint32(16)
    starts = np.flatnonzero(before == 32)
    ends = np.cumsum([len(p) + 1 for p in pieces])
    return gram, starts, np.searchsorted(ends, at[starts] - 1, side="right")


def _together(texts, size: int):
    """Lists of (place of the text, piece) of about so many bytes each."""
    some, room = [], 0
    for i, text in enumerate(texts):
        for piece in _pieces(text, size) if text else ():
            if some and room + len(piece) > size:
                yield some
                some, room = [], 0
            some.append((i, piece))
            room += len(piece) + 1
    if some:
        yield some


def _count(batches):
    held: dict[str, np.ndarray] = {}
    for pdf in batches:
        for lang, texts in pdf.groupby("lang")["text"]:
            into = held.setdefault(lang, np.zeros(GRAMS, np.int64))
            for some in _together(texts, PIECE):
                into += np.bincount(_grams([p for _, p in some])[0], minlength=GRAMS)
    for lang, into in held.items():
        some = np.flatnonzero(into)
        yield pd.DataFrame({"lang": lang, "gram": some.astype(np.int32), "n": into[some]})


def fit_languages(docs: DataFrame, max_languages: int = 128, smoothing: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Language values in order, and log P(trigram | language) as an array (trigrams, languages).

    Learns from every row with text, language and an id that isn't held out. The result has at most
    65,536 x ``max_languages`` numbers, whatever the input; more languages than that are an error.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = known.mapInPandas(_count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    got = counted.limit(GRAMS * max_languages + 1).toPandas()
    names = sorted(got["lang"].unique())
    if len(names) > max_languages:
        raise ValueError(f"{len(names)} languages; max_languages is {max_languages}")
    counts = np.zeros((GRAMS, len(names)))
    for j, name in enumerate(names):
        own = got[got["lang"] == name]
        counts[own["gram"].to_numpy(), j] = own["n"].to_numpy()
    return names, np.log((counts + smoothing) / (counts.sum(0) + smoothing * GRAMS)).astype(np.float32)


def _em(ratio: np.ndarray, starts: np.ndarray, share: np.ndarray, tolerance: float = 1e-3, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Shares when no step moves one by ``tolerance`` any more, and each text's log likelihood (less the constant of
    ``ratio``). A share of 0 stays 0. Texts that have settled take no more steps."""
    whole = ratio, starts
    words = np.diff(np.append(starts, len(ratio)))
    out, open_, own = share.copy(), np.arange(len(starts)), words
    of = np.repeat(np.arange(len(starts)), words)
    for _ in range(steps):
        part = ratio * share[of]
        part /= part.sum(1, keepdims=True)
        new = np.add.reduceat(part, starts, axis=0) / own[:, None]
        moving = np.abs(new - share).max(1) >= tolerance
        share = new
        if moving.mean() > 0.7:
            continue
        out[open_] = share
        if not moving.any():
            break
        ratio, open_, own, share = ratio[moving[of]], open_[moving], own[moving], share[moving]
        starts = np.concatenate([[0], np.cumsum(own)[:-1]])
        of = np.repeat(np.arange(len(starts)), own)
    else:
        out[open_] = share
    ratio, starts = whole
    return out, np.add.reduceat(np.log((ratio * out[np.repeat(np.arange(len(starts)), words)]).sum(1)), starts)


def mixture(ratio: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Shares of the languages in each text. ratio: each word's likelihood over its best language's; starts: of texts.

    From all languages on, those of less than half a word go, or else that of the least share, down to one language;
    of all the sets met the cheapest is taken. No word is likelier than under its best language, so a set of k costs
    (k - 1) log(words) at least, and texts whose best set costs less already than two languages could are settled.
    """
    n_texts, n_langs = len(starts), ratio.shape[1]
    words = np.diff(np.append(starts, len(ratio)))
    alone = np.add.reduceat(np.log(ratio), starts, axis=0)
    best = np.argmax(alone, axis=1)
    out = np.zeros((n_texts, n_langs))
    out[np.arange(n_texts), best] = 1
    penalty = np.log(words)
    cost = -2.0 * alone[np.arange(n_texts), best]
    open_ = np.flatnonzero((cost > penalty) & (n_langs > 1))
    share = np.full((len(open_), n_langs), 1 / n_langs)
    while len(open_):
        keep = np.zeros(n_texts, bool)
        keep[open_] = True
        own = words[open_]
        share, fit = _em(ratio[np.repeat(keep, words)], np.concatenate([[0], np.cumsum(own)[:-1]]), share)
        now = -2 * fit + ((share > 0).sum(1) - 1) * penalty[open_]
        better = now < cost[open_]
        out[open_[better]], cost[open_[better]] = share[better], now[better]
        few = (share * own[:, None] < 0.5) & (share > 0) & (share < share.max(1, keepdims=True))
        none = ~few.any(1)
        few[np.flatnonzero(none), np.where(share[none] > 0, share[none], 2).argmin(1)] = True
        share[few] = 0
        left = ((share > 0).sum(1) > 1) & (cost[open_] > penalty[open_])
        open_, share = open_[left], share[left] / share[left].sum(1, keepdims=True)
    return out


def has_letter(text: str | None) -> bool:
    found = _LETTER.search(text) if text else None
    # the pattern takes numerals such as a superscript for letters too
    return found is not None and (found[0].isalpha() or any(map(str.isalpha, text)))


def shares_of(texts: list[str | None], table: np.ndarray) -> np.ndarray:
    """Language shares of each text, zero where it has no letter."""
    out = np.zeros((len(texts), table.shape[1]))
    rows: list[int] = []
    ratios: list[np.ndarray] = []
    sizes: list[int] = []

    def settle():
        if rows:
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            out[rows] = mixture(np.concatenate(ratios), starts)
        for x in (rows, ratios, sizes):
            x.clear()

    # a trigram's row has a number for each language, so pieces are shorter where there are many
    for some in _together([t if has_letter(t) else None for t in texts], max(1 << 14, min(PIECE, (1 << 23) // table.shape[1]))):
        if rows and some[0][0] != rows[-1]:  # the last text is complete
            settle()
        gram, starts, piece = _grams([p for _, p in some])
        if not len(starts):
            continue
        ll = np.add.reduceat(table[gram], starts, axis=0)
        ratio = np.exp(np.maximum(ll - ll.max(1, keepdims=True), np.float32(-60)))
        n = np.bincount(piece, minlength=len(some))
        edges = np.concatenate([[0], np.cumsum(n)])
        for p in np.flatnonzero(n):
            if rows and rows[-1] == some[p][0]:
                sizes[-1] += n[p]
            else:
                rows.append(some[p][0])
                sizes.append(n[p])
            ratios.append(ratio[edges[p] : edges[p + 1]])
    settle()
    return out


def detect_languages(docs: DataFrame, names: list[str], log_p: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, languages`` for every row, from its whole text alone.

    ``languages`` are all of the chosen set with their shares, largest first; ``lang_pred`` is the first (ties: by
    name) and ``score`` its share. A null text, one without a letter and any text when nothing was learned give
    ``und``, 0 and an empty list. Very long texts are read in pieces that count together. Repeated rows are each judged.
    An empty table gives an empty result. Other columns of ``docs`` aren't read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(log_p)  # bounded by max_languages

    @F.pandas_udf("lang_pred string, score double, languages array<struct<lang:string,share:double>>")
    def detect(texts: pd.Series) -> pd.DataFrame:
        share = shares_of(texts.tolist(), shipped.value) if names else np.zeros((len(texts), 1))
        best, top = share.argmax(1), share.max(1)
        order = np.argsort(-share, axis=1, kind="stable")
        return pd.DataFrame(
            {
                "lang_pred": [names[b] if t > 0 else "und" for b, t in zip(best, top, strict=True)],
                "score": np.minimum(top, 1.0),
                "languages": [[{"lang": names[j], "share": float(row[j])} for j in o[: np.count_nonzero(row)]] for row, o in zip(share, order, strict=True)],
            }
        )

    found = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), detect(F.col(text_col)).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.languages")
