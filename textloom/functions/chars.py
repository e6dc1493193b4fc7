"""Predicates on tokens as Column expressions; all are false on the empty string but for ``is_blank``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_MARKS = "…:;!?."
HYPHENS = "-–—~"
OPEN_QUOTES = "\"'`‘“«‹„‚"
QUOTES = OPEN_QUOTES + "’”»›"


def _is(x: Column, pattern: str) -> Column:
    return F.coalesce(x, F.lit("")).rlike(pattern)


def is_blank(x: Column) -> Column:
    return _is(x, r"^[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]*$")


def is_all_upper(x: Column) -> Column:
    """No lower-case letter, so ``123`` counts."""
    return (F.coalesce(x, F.lit("")) != "") & ~_is(x, r"\p{Ll}")


def is_all_lower(x: Column) -> Column:
    """No upper-case letter, so ``123`` counts."""
    return (F.coalesce(x, F.lit("")) != "") & ~_is(x, r"\p{Lu}")


def is_capitalized(x: Column) -> Column:
    return _is(x, r"^\p{Lu}") & ~is_all_upper(x)


def is_letter_or_digit(x: Column) -> Column:
    return _is(x, r"^[\p{L}\p{Nd}]+$")


def is_letter(x: Column) -> Column:
    return _is(x, r"^\p{L}+$")


def is_digit(x: Column) -> Column:
    return _is(x, r"^\p{Nd}+$")


def is_numeric(x: Column) -> Column:
    return _is(x, r"^[0-9]+$")


def has_numeric(x: Column) -> Column:
    return _is(x, r"[0-9]")


def is_sentence_punctuation(x: Column) -> Column:
    return _is(x, r"^[…:;!?.]+$")


def has_punctuation(x: Column) -> Column:
    return _is(x, r"\p{P}")


def is_punctuation(x: Column) -> Column:
    return _is(x, r"^\p{P}+$")


def is_symbol(x: Column) -> Column:
    return _is(x, r"^\p{S}+$")


def is_currency(x: Column) -> Column:
    return _is(x, r"^\p{Sc}+$")


def is_hyphen(x: Column) -> Column:
    return _is(x, r"^[-–—~]+$")


def is_open_quote(x: Column) -> Column:
    return _is(x, rf"^[{OPEN_QUOTES}]+$")


def is_quote(x: Column) -> Column:
    return _is(x, rf"^[{QUOTES}]+$")


def is_email_local_part(x: Column) -> Column:
    return _is(x, r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~.-]+$")


def is_email_domain(x: Column) -> Column:
    return _is(x, r"^[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$")


LIGATURES = {
    "Ǳ": "DZ", "ǲ": "Dz", "ǳ": "dz", "Ǆ": "DŽ", "ǅ": "Dž", "ǆ": "dž", "Ǉ": "LJ", "ǈ": "Lj", "ǉ": "lj", "Ǌ": "NJ", "ǋ": "Nj", "ǌ": "nj",
    "Ꜳ": "AA", "ꜳ": "aa", "Æ": "AE", "æ": "ae", "Ꜵ": "AO", "ꜵ": "ao", "Ꜷ": "AU", "ꜷ": "au", "Ꜹ": "AV", "ꜹ": "av", "Ꜻ": "AV", "ꜻ": "av", "Ꜽ": "AY", "ꜽ": "ay", "Ĳ": "IJ", "ĳ": "ij", "Œ": "OE", "œ": "oe", "Ꝏ": "OO", "ꝏ": "oo",
    "Ꜩ": "TZ", "ꜩ": "tz", "ᵫ": "ue", "Ꝡ": "VY", "ꝡ": "vy", "ﬅ": "st",
    "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬆ": "st",
}


def has_ligatures(x: Column) -> Column:
    return _is(x, f"[{''.join(LIGATURES)}]")


#: Something with a scheme, ``www.``, a dotted domain or a mail address.
URL_OR_EMAIL = r"^(?:(?:https?|ftp)://\S+|www\.\S+\.\S+|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}|(?:[A-Za-z0-9-]+\.)+(?:com|org|net|edu|gov|io|info|co|de|fr|es|it|uk|eu)(?:[/:?#]\S*)?)$"
EMAIL = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}$"


def like_url_or_email(x: Column) -> Column:
    return _is(x, URL_OR_EMAIL)


def like_email(x: Column) -> Column:
    return _is(x, EMAIL)


def like_url(x: Column) -> Column:
    return like_url_or_email(x) & ~like_email(x)


def is_emoji(x: Column) -> Column:
    """The whole token is one emoji: a pictograph with its modifiers, joined ones, a flag or a key cap."""
    one = r"(?:[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{2190}-\x{21FF}\x{2B00}-\x{2BFF}\x{231A}-\x{23FF}][\x{FE0F}\x{1F3FB}-\x{1F3FF}]*[\x{E0020}-\x{E007F}]*)"
    return _is(x, rf"^(?:{one}(?:\x{{200D}}{one})*|[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}|[0-9#*]\x{{FE0F}}?\x{{20E3}})$")


def shape(x: Column, compact: bool = False) -> Column:
    """Each character's class: @ ~ / (either slash) - (hyphens) x X 9 . (punctuation) #; compact joins equal neighbours."""
    out = x
    for pattern, to in ((r"[/\\]", "\x01"), (r"~", "\x02"), (r"@", "\x03"), (r"[-–—]", "\x04"), (r"\p{Ll}", "\x05"), (r"\p{Lu}", "\x06"), (r"\p{N}", "\x07"), (r"\p{P}", "\x08"), (r"[^\x01-\x08]", "#")):
        out = F.regexp_replace(out, pattern, to)
    out = F.translate(out, "\x01\x02\x03\x04\x05\x06\x07\x08", "/~@-xX9.")
    return F.regexp_replace(out, r"(.)\1+", "$1") if compact else out
