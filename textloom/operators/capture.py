"""Captures from token context: hyphenated words, abbreviations with what they stand for, dates."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.operators.tokenize import Tokenizer, exceptions_for

_WORD, _HYPHEN = r"[\p{L}\p{Nd}]+", r"[-–—~]"
ABBREVIATION = "struct<abbreviation:string,description:string,context:array<string>>"


def hyphenated_words(text: Column) -> Column:
    """Words joined by hyphens, with or without one blank on either side, chains as one; neighbours aren't punctuation."""
    return F.regexp_extract_all(text, F.lit(rf"(?<![\p{{L}}\p{{Nd}}\p{{P}}])({_WORD}(?: ?{_HYPHEN} ?{_WORD})+)(?![\p{{L}}\p{{Nd}}])"), 1)


def _is_sub_sequence(letters: str, text: str) -> bool:
    rest = iter(text)
    return all(c in rest for c in letters)


def _described(values: list[str], at: int, short: str) -> str | None:
    """What the tokens before a bracket say the abbreviation is, or None."""
    letters = [c for c in short if c.isupper()]
    words: list[str] = []
    for k in range(at - 1, max(-1, at - 1 - 5 * len(letters)), -1):
        if values[k] in "()[]":
            break
        words.insert(0, values[k])
        if words[0][:1].upper() == letters[0] and _is_sub_sequence("".join(letters).lower(), " ".join(words).lower()) and all(any(c in w.upper() for w in words) for c in letters):
            full = " ".join(words)
            return None if full == full.upper() or short in words else full
    return None


def abbreviations(text: Column, context: int = 250, lang: str | None = "en") -> Column:
    """``array<struct<abbreviation, description, context>>``: short forms in brackets after their long form.

    The bracket's token with the most capitals counts, if it has two or more, they are over half of it, and it is of
    100 characters at most; the tokens before it, five a letter at most, must hold its letters in order.
    """
    exceptions = exceptions_for(lang)

    @F.pandas_udf(f"array<{ABBREVIATION}>")
    def capture(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = Tokenizer(exceptions)
        for texts in batches:
            out = []
            for text in texts:
                found = []
                tokens = tokenizer.cut(text) if text and re.search(r"[(\[][^()\[\]]*[A-Z]", text) else []
                values = [t[2] for t in tokens]
                for at, v in enumerate(values):
                    if v not in "([" or not v:
                        continue
                    inner = []
                    for k in range(at + 1, min(len(values), at + 11)):
                        if values[k] in ")]":
                            break
                        inner.append(k)
                    else:
                        continue
                    if not inner:
                        continue
                    best = max(inner, key=lambda k: sum(c.isupper() for c in values[k]))
                    short = values[best]
                    capitals = sum(c.isupper() for c in short)
                    if capitals < 2 or 2 * capitals <= len(short) or len(short) > 100:
                        continue
                    full = _described(values, at, short)
                    if full:
                        a, b = tokens[best][0], tokens[best][1]
                        found.append({"abbreviation": short, "description": full, "context": [v for s, e, v, _ in tokens if s >= a - context and e <= b + context]})
                out.append(found)
            yield pd.Series(out)

    return capture(text)


_MONTHS = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
DATES = rf"(?i)\b(\d{{4}}-\d{{2}}-\d{{2}}(?:[T ]\d{{2}}:\d{{2}}(?::\d{{2}})?)?|\d{{1,2}}[./]\d{{1,2}}[./]\d{{2,4}}|(?:{_MONTHS})\.? \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}}|\d{{1,2}}(?:st|nd|rd|th)? (?:{_MONTHS})\.?,? \d{{4}}|\d{{1,2}}:\d{{2}}(?: ?[ap]m)?|today|tomorrow|yesterday)\b"


def dates(text: Column) -> Column:
    """Expressions of dates and times, as they stand in the text."""
    return F.regexp_extract_all(text, F.lit(DATES), 1)


def resolved_date(expression: Column) -> Column:
    """The day that an ISO or dotted or written date names, else null."""
    year_first = F.try_to_timestamp(F.substring(expression, 1, 10), F.lit("yyyy-MM-dd"))
    dotted = F.try_to_timestamp(expression, F.lit("d.M.yyyy"))
    written = F.try_to_timestamp(F.regexp_replace(expression, r"(?<=\d)(?:st|nd|rd|th)|,|\.", ""), F.lit("MMMM d yyyy"))
    return F.coalesce(year_first, dotted, written).cast("date")


def tokens_inside(tokens: Column, begin: Column, end: Column) -> Column:
    """Tokens whose bounds lie within a range of characters (ends inclusive)."""
    return F.filter(tokens, lambda t: (t["begin"] >= begin) & (t["end"] <= end))
