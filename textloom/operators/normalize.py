"""Normalizers that need a parser or tokens: markup to text, token replacements, numbers, spelling."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions import chars


class _Reader(HTMLParser):
    """Text of a page: scripts and styles skipped, a line end after blocks and breaks, lists set in."""

    BLOCKS = frozenset({"p", "br", "table", "th", "tr", "li", "div", "h1", "h2", "h3", "h4", "h5", "h6"})

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = self.indent = 0

    def _line(self) -> None:
        if self.out and not self.out[-1].endswith("\n"):
            self.out.append("\n")

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        self.indent += tag in ("ul", "ol", "li")
        if tag == "br":
            self._line()

    def handle_endtag(self, tag):
        self.skip = max(0, self.skip - (tag in ("script", "style")))
        self.indent = max(0, self.indent - (tag in ("ul", "ol", "li")))
        if tag in self.BLOCKS:
            self._line()

    def handle_data(self, data):
        if not self.skip and data.strip():
            self.out.append(" " * self.indent * (not self.out or self.out[-1].endswith("\n")) + data + " " * (not data[-1].isspace()))


def html_to_text(html: Column) -> Column:
    """What a page says, with no ``<`` or ``>`` of markup left; a text without tags or ``&nbsp;`` stays as it is."""

    @F.pandas_udf("string")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            out = []
            for page in pages:
                reader = _Reader()
                reader.feed(page)
                reader.close()
                out.append("".join(reader.out).replace("<", " ").replace(">", " "))
            yield pd.Series(out)

    marked = html.rlike(r"<[^>]*>|&nbsp;")
    return F.when(marked, read(F.when(marked, html).otherwise(""))).otherwise(html)


def remove_punctuation(tokens: Column) -> Column:
    """Tokens with a ``replacement``: hyphens alone one hyphen, inner hyphens underscores, any with punctuation nothing."""
    of = lambda v: F.when(chars.is_hyphen(v), "-").when(v.rlike(r"^[\p{L}\p{Nd}]+(?:[-–—~][\p{L}\p{Nd}]+)+$"), F.regexp_replace(v, "[-–—~]", "_")).when(chars.has_punctuation(v), "")
    return F.transform(tokens, lambda t: t.withField("replacement", of(t["value"])))


def number_to_word(tokens: Column, word: str = "_number_") -> Column:
    return F.transform(tokens, lambda t: t.withField("replacement", F.when(chars.is_numeric(t["value"]), word)))


def with_replacements(tokens: Column) -> Column:
    """Values replaced where there is a replacement; emptied tokens left out."""
    put = F.transform(tokens, lambda t: t.withField("value", F.coalesce(t["replacement"], t["value"])))
    return F.filter(put, lambda t: t["value"] != "")


def map_spelling(tokens: DataFrame, table: DataFrame) -> DataFrame:
    """``tokens`` with ``term`` as the table (``word, spelling``) has it, else as it is."""
    return tokens.join(table.select(F.col("word").alias("term"), F.col("spelling")), "term", "left").withColumn("term", F.coalesce("spelling", "term")).drop("spelling")
