"""Small fixed tables: languages, parts of speech, stop words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Languages by ISO 639 code (fixed values).
LANGUAGES = {
    "af": "Afrikaans", "ar": "Arabic", "hy": "Armenian", "eu": "Basque", "be": "Belarusian", "bg": "Bulgarian", "ca": "Catalan", "zh": "Chinese", "cu": "Church Slavic", "hr": "Croatian",
    "cs": "Czech", "da": "Danish", "nl": "Dutch", "en": "English", "et": "Estonian", "fo": "Faroese", "fi": "Finnish", "fr": "French", "gd": "Gaelic", "gl": "Galician",
    "de": "German", "el": "Greek", "he": "Hebrew", "hi": "Hindi", "hu": "Hungarian", "is": "Icelandic", "id": "Indonesian", "ga": "Irish", "it": "Italian", "ja": "Japanese",
    "kk": "Kazakh", "ko": "Korean", "la": "Latin", "lv": "Latvian", "lt": "Lithuanian", "lb": "Luxembourgish", "mk": "Macedonian", "mt": "Maltese", "mr": "Marathi", "no": "Norwegian",
    "nb": "Norwegian Bokmal", "fa": "Persian", "pl": "Polish", "pt": "Portuguese", "ro": "Romanian", "ru": "Russian", "sr": "Serbian", "sk": "Slovak", "sl": "Slovenian", "es": "Spanish",
    "sv": "Swedish", "tl": "Tagalog", "ta": "Tamil", "te": "Telugu", "tr": "Turkish", "ug": "Uighur", "uk": "Ukrainian", "ur": "Urdu", "vi": "Vietnamese", "wo": "Wolof",
}

#: Penn Treebank tags and the universal part of speech of each (fixed values).
PENN_TO_UNIVERSAL = {
    "#": "SYM", "$": "SYM", "''": "PUNCT", ",": "PUNCT", "-LRB-": "PUNCT", "-RRB-": "PUNCT", ".": "PUNCT", ":": "PUNCT", "``": "PUNCT", "HYPH": "PUNCT", "NFP": "PUNCT",
    "AFX": "ADJ", "JJ": "ADJ", "JJR": "ADJ", "JJS": "ADJ", "CC": "CCONJ", "CD": "NUM", "DT": "DET", "PDT": "DET", "WDT": "DET", "EX": "PRON", "PRP": "PRON", "PRP$": "PRON", "WP": "PRON", "WP$": "PRON",
    "FW": "X", "LS": "X", "XX": "X", "ADD": "X", "GW": "X", "IN": "ADP", "RP": "ADP", "MD": "AUX", "NN": "NOUN", "NNS": "NOUN", "NNP": "PROPN", "NNPS": "PROPN", "POS": "PART", "TO": "PART",
    "RB": "ADV", "RBR": "ADV", "RBS": "ADV", "WRB": "ADV", "SYM": "SYM", "UH": "INTJ", "VB": "VERB", "VBD": "VERB", "VBG": "VERB", "VBN": "VERB", "VBP": "VERB", "VBZ": "VERB",
}

#: Frequent function words, by language.
STOP_WORDS = {
    "en": frozenset("a an and are as at be but by for from had has have he her his i in is it its not of on or she so that the their them they this to was we were what which who will with you".split()),
    "de": frozenset("aber als am an auch auf aus bei das dem den der des die doch ein eine einen einer es für hat ich im in ist mit nach nicht oder sich sie sind so und von war was wie wir zu zum".split()),
    "fr": frozenset("au aux avec ce cette ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous".split()),
    "es": frozenset("a al como con de del el ella en era es esta este ha la las lo los más me mi no o para pero por que se si sin su sus un una y ya yo".split()),
}


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(LANGUAGES.items()), "lang string, name string")


def universal_tag(penn: Column) -> Column:
    """The universal part of speech of a Penn tag, X where there is none."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PENN_TO_UNIVERSAL.items() for x in kv]), penn), F.lit("X"))


def stop_words(lang: str, more: dict[str, set[str]] | None = None) -> frozenset[str]:
    """The language's words and those of ``more``; none for a language in neither."""
    return STOP_WORDS.get(lang, frozenset()) | frozenset((more or {}).get(lang, ()))


def stop_word_table(spark: SparkSession, more: dict[str, set[str]] | None = None) -> DataFrame:
    """``lang, term`` of all languages."""
    return spark.createDataFrame([(lang, w) for lang in sorted({*STOP_WORDS, *(more or {})}) for w in sorted(stop_words(lang, more))], "lang string, term string")
