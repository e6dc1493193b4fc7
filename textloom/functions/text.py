"""Text normalizers as Column expressions."""

from __future__ import annotations

import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.chars import LIGATURES


def lower_case(x: Column) -> Column:
    return F.lower(x)


def upper_case(x: Column) -> Column:
    """Upper case one character for one: ß stays."""
    return F.replace(F.upper(F.replace(x, F.lit("ß"), F.lit("\x01"))), F.lit("\x01"), F.lit("ß"))


def remove_control_characters(x: Column) -> Column:
    """Control characters go, but for line ends; U+F022 becomes a blank."""
    return F.replace(F.regexp_replace(x, r"[\x00-\x09\x0b\x0c\x0e-\x1f\x7f-\x9f]", ""), F.lit("\uf022"), F.lit(" "))


def clean_text(x: Column) -> Column:
    """What a new document keeps of its text: no control characters, and nothing of a blank text."""
    cleaned = remove_control_characters(F.coalesce(x, F.lit("")))
    return F.when(cleaned.rlike(r"^\s*$"), "").otherwise(cleaned)


def remove_quotes_and_trim(x: Column) -> Column:
    bare = F.regexp_replace(x, "[\"'`‘’“”«»‹›„‚]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def remove_ligatures(x: Column) -> Column:
    for one, letters in LIGATURES.items():
        x = F.replace(x, F.lit(one), F.lit(letters))
    return x


def _fold_tables() -> tuple[str, str, dict[str, str]]:
    """Characters from U+00C0 on whose compatibility decomposition is ASCII once its marks are gone."""
    one, to, more = [], [], {"ß": "ss", "Æ": "AE", "æ": "ae", "Œ": "OE", "œ": "oe", "Ø": "O", "ø": "o", "Đ": "D", "đ": "d", "Ð": "D", "ð": "d", "Þ": "TH", "þ": "th", "Ł": "L", "ł": "l", "ı": "i", "Ħ": "H", "ħ": "h", "ŋ": "n", "Ŋ": "N"}
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x2010, 0x2050), *range(0x2070, 0x20A0), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFF5F)]:
        c = chr(point)
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c in more or not plain or plain == c or not plain.isascii():
            continue
        if len(plain) == 1:
            one.append(c)
            to.append(plain)
        else:
            more[c] = plain
    return "".join(one), "".join(to), more


_ONE, _TO, _MORE = _fold_tables()


def fold_to_ascii(x: Column) -> Column:
    singles = {c: t for c, t in _MORE.items() if len(t) == 1}
    x = F.translate(x, _ONE + "".join(singles), _TO + "".join(singles.values()))
    for c, t in _MORE.items():
        if len(t) > 1:
            x = F.replace(x, F.lit(c), F.lit(t))
    return x


def _mark_tables() -> tuple[str, str]:
    """Letters that are one base character and non-spacing marks, and the base."""
    pairs = []
    for point in range(0xC0, min(sys.maxunicode, 0x2000)):
        plain = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", chr(point)) if unicodedata.category(x) != "Mn"))
        if len(plain) == 1 and plain != chr(point):
            pairs.append((chr(point), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _BARE = _mark_tables()


def remove_diacritics(x: Column) -> Column:
    return F.translate(F.regexp_replace(x, r"\p{Mn}", ""), _MARKED, _BARE)


def title_case(x: Column) -> Column:
    """Upper case at the start and after white space or punctuation other than ', lower case elsewhere."""
    words = F.regexp_extract_all(x, F.lit(r"(?s)((?:[^\s\p{P}]|')+|[\s\p{P}&&[^']])"), 1)
    return F.array_join(F.transform(words, lambda w: F.concat(upper_case(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1_000_000_000)))), "")


def strip_tags(html: Column) -> Column:
    """Plain reading of markup: scripts, styles, comments and tags go."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->", "")
    return F.regexp_replace(bare, r"(?s)<[^>]*>", " ")


def is_sub_sequence(letters: Column, of: Column) -> Column:
    """The letters occur in this order in the other text."""
    left = F.aggregate(F.split(of, ""), letters, lambda rest, c: F.when((rest != "") & (F.substring(rest, 1, 1) == c), F.substring(rest, 2, 1_000_000)).otherwise(rest))
    return left == ""


def appears_in(x: Column, of: Column) -> Column:
    """The text occurs in the other, in any case."""
    return F.contains(F.lower(of), F.lower(x))
