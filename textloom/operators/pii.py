"""Personal data: recognizers, masking, and cloaking that can be undone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.patterns import Pattern, Recognizer, Unit, find_entities

_DIGIT = r"[0-9]"


def _number(least: int, most: int | None = None, prefix: str | None = None) -> Unit:
    unit = Unit().is_numeric().length(least, most or least)
    return unit.prefix(prefix) if prefix else unit


def _groups(*sizes: int, prefix: str | None = None) -> tuple[Unit, ...]:
    return tuple(_number(n, prefix=prefix if not k else None) for k, n in enumerate(sizes))


def _abroad(code: str, *rest: Unit) -> tuple[Unit, ...]:
    return Unit().token("+"), Unit().token(code), *rest


def _recognizer(entity_type: str, *alternatives: tuple[Unit, ...], guard: str | None = _DIGIT) -> Recognizer:
    pattern = Pattern(entity_type)
    for units in alternatives:
        pattern.add(*units)
    return Recognizer(entity_type, [pattern], guard)


# fixed values: the token patterns of each kind
EMAIL = _recognizer("EMAIL_ADDRESS", (Unit().like_email(),), guard="@")
URL = _recognizer("URL", (Unit().like_url(),), guard=r"[:.]")
CREDIT_CARD = _recognizer("CREDIT_CARD", _groups(4, 4, 4, 4))
IP = _recognizer("IP_ADDRESS", (Unit().like_ip(),))
US_SSN = _recognizer("US_SSN", (Unit().shape("999-99-9999"),))
US_PASSPORT = _recognizer("US_PASSPORT", _groups(9))
IBAN = _recognizer("IBAN_CODE", (Unit().is_letter_or_digit().length(15, 34).prefix("GB,DE,FR,IT,ES"),))
US_ITIN = _recognizer("US_ITIN", (Unit().shape("999-99-9999").prefix("9"),))
CRYPTO = _recognizer("CRYPTO", (Unit().is_letter_or_digit().length(26, 35).prefix("1,3"),), (Unit().is_letter_or_digit().length(39, 62).prefix("bc1"),))
US_DRIVER_LICENSE = _recognizer("US_DRIVER_LICENSE", (Unit().shape("X9999999"),), (Unit().shape("X99999999"),), _groups(9))
US_BANK_NUMBER = _recognizer("US_BANK_NUMBER", _groups(9))
UK_NHS = _recognizer("UK_NHS", _groups(10), _groups(3, 3, 4))
ES_NIF = _recognizer("ES_NIF", (Unit().shape("99999999X"),), (Unit().shape("X9999999X"),))
IT_FISCAL_CODE = _recognizer("IT_FISCAL_CODE", (Unit().shape("XXXXXX99X99X999X"),))
SG_NRIC = _recognizer("SG_NRIC_FIN", (Unit().shape("X9999999X"),))
AU_ABN = _recognizer("AU_ABN", _groups(11), _groups(2, 3, 3, 3))
AU_TFN = _recognizer("AU_TFN", (_number(8, 9),), _groups(3, 3, 3))
PHONE_US = _recognizer("PHONE_US", (Unit().shape("999-999-9999"),), (Unit().opens(), _number(3), Unit().closes(), Unit().shape("999-9999")))
PHONE_UK = _recognizer("PHONE_UK", _groups(5, 6, prefix="0"), _groups(3, 4, 4, prefix="0"), _abroad("44", *_groups(4, 6)))
PHONE_DE = _recognizer("PHONE_DE", (_number(3, 5, "0"), _number(3, 8)), _abroad("49", _number(2, 5), _number(3, 8)))
PHONE_FR = _recognizer("PHONE_FR", _groups(2, 2, 2, 2, 2, prefix="0"), _abroad("33", *_groups(1, 2, 2, 2, 2)))
PHONE_BR = _recognizer("PHONE_BR", (Unit().opens(), _number(2), Unit().closes(), Unit().shape("99999-9999", "9999-9999")), _abroad("55", _number(2), Unit().shape("99999-9999")))
PHONE_IN = _recognizer("PHONE_IN", _abroad("91", *_groups(5, 5)), (_number(3, 5, "0"), _number(5, 8)))
PHONE_CN = _recognizer("PHONE_CN", _abroad("86", _number(3, prefix="1"), *_groups(4, 4)))
PHONE_AU = _recognizer("PHONE_AU", _groups(2, 4, 4, prefix="0"), _abroad("61", *_groups(1, 4, 4)))
PHONES = [PHONE_US, PHONE_UK, PHONE_DE, PHONE_FR, PHONE_BR, PHONE_IN, PHONE_CN, PHONE_AU]
ALL = [EMAIL, URL, CREDIT_CARD, IP, US_SSN, US_PASSPORT, IBAN, US_ITIN, CRYPTO, US_DRIVER_LICENSE, US_BANK_NUMBER, UK_NHS, ES_NIF, IT_FISCAL_CODE, SG_NRIC, AU_ABN, AU_TFN, *PHONES]


class Analyzer:
    """Recognizers put together; ``analyze`` adds the column ``findings``."""

    def __init__(self, lang: str | None = "en", recognizers: list[Recognizer] | None = None):
        self.lang, self.recognizers = lang, list(recognizers or [])

    def add(self, *recognizers: Recognizer) -> Analyzer:
        return Analyzer(self.lang, [*self.recognizers, *recognizers])

    def add_all(self) -> Analyzer:
        return self.add(*ALL)

    def analyze(self, df: DataFrame, text_col: str = "text", into: str = "findings") -> DataFrame:
        return df.withColumn(into, find_entities(F.col(text_col), self.recognizers, self.lang))


def without_overlaps(findings: Column, text: Column) -> Column:
    """Findings inside the text by start, those that begin in an earlier kept one left out (ties: score, then length)."""
    inside = F.filter(findings, lambda f: (f["start"] >= 0) & (f["end"] < F.length(text)) & (f["start"] <= f["end"]))
    keyed = F.array_sort(F.transform(inside, lambda f: F.struct(f["start"].alias("start"), (-f["score"]).alias("_score"), (-f["end"]).alias("_end"), f.alias("f"))))
    empty = F.filter(inside, lambda f: F.lit(False))
    start = F.struct(F.lit(-1).alias("last"), empty.alias("kept"))
    step = lambda acc, k: F.when(k["start"] > acc["last"], F.struct(k["f"]["end"].alias("last"), F.array_append(acc["kept"], k["f"]).alias("kept"))).otherwise(acc)
    return F.aggregate(keyed, start, step, lambda acc: acc["kept"])


def _spliced(text: Column, findings: Column, put) -> Column:
    part = lambda f: F.substring(text, f["start"] + 1, f["end"] - f["start"] + 1)
    return F.aggregate(F.reverse(findings), text, lambda acc, f: F.concat(F.substring(acc, F.lit(1), f["start"]), put(f, part(f)), F.substring(acc, f["end"] + 2, F.length(acc))))


def anonymize(text: Column, findings: Column, how: str = "mask", mask_char: str = "*", replacement: str = "<REDACTED>") -> Column:
    """The text with its findings masked (a character for each), replaced, redacted (nothing left) or hashed (SHA-256, hex)."""
    puts = {
        "replace": lambda f, part: F.lit(replacement),
        "redact": lambda f, part: F.lit(""),
        "hash": lambda f, part: F.sha2(part, 256),
        "mask": lambda f, part: F.repeat(F.lit(mask_char), f["end"] - f["start"] + 1),
    }
    put = puts.get(how, lambda f, part: F.repeat(F.lit("*"), f["end"] - f["start"] + 1))
    return _spliced(text, without_overlaps(findings, text), put)


def cloak_dictionary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", findings_col: str = "findings", strips: int = 4096) -> DataFrame:
    """``value, name``: each value found gets a name ``TYPE_n``, numbered by type in the order of first use.

    A value found under two types has the name of its first use. Ids are numbers; values are numbered in ``strips``
    ranges of ids at once, each going on from the counts of those before it, so no type is numbered by one task.
    """
    text = F.col(text_col)
    found = df.select(F.col(id_col).alias("_id"), text.alias("_text"), F.explode_outer(without_overlaps(F.col(findings_col), text)).alias("_f")).where("_f is not null")
    used = found.select(F.struct(F.col("_id"), F.col("_f.start").alias("start")).alias("at"), F.col("_f.entity_type").alias("type"), F.substring(F.col("_text"), F.col("_f.start") + 1, F.col("_f.end") - F.col("_f.start") + 1).alias("value"))
    first = used.groupBy("value").agg(F.min(F.struct("at", "type")).alias("first"))
    low, high = df.agg(F.min(id_col), F.max(id_col)).first()
    width = max(1, ((high or 0) - (low or 0)) // strips + 1)
    each = first.select("value", F.upper("first.type").alias("type"), "first.at", F.floor((F.col("first.at._id") - (low or 0)) / width).alias("strip"))
    counts = each.groupBy("type", "strip").agg(F.count("*").alias("n"))
    before = counts.select("type", "strip", F.coalesce(F.sum("n").over(Window.partitionBy("type").orderBy("strip").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = each.withColumn("n", F.row_number().over(Window.partitionBy("type", "strip").orderBy("at")))
    return own.join(before, ["type", "strip"]).select("value", F.concat("type", F.lit("_"), (F.col("n") + F.col("before")).cast("string")).alias("name"))


def cloak(df: DataFrame, names: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", findings_col: str = "findings") -> DataFrame:
    """``df`` with ``cloaked`` text and the ``mapping`` (array of struct name, value) that undoes it."""
    names = names if names is not None else cloak_dictionary(df, id_col, text_col, findings_col)
    text = F.col(text_col)
    kept = df.withColumn("_row", F.xxhash64(id_col, text_col)).withColumn("_kept", without_overlaps(F.col(findings_col), text))
    each = kept.select("_row", F.explode_outer("_kept").alias("_f"), text.alias("_text")).where("_f is not null").select("_row", "_f", F.substring(F.col("_text"), F.col("_f.start") + 1, F.col("_f.end") - F.col("_f.start") + 1).alias("value")).distinct()
    put = each.join(names, "value").groupBy("_row").agg(F.array_sort(F.collect_list(F.struct(F.col("_f.start").alias("start"), F.col("_f.end").alias("end"), "name", "value"))).alias("_put"))
    joined = kept.join(put, "_row", "left")
    cloaked = F.when(F.col("_put").isNull(), text).otherwise(_spliced(text, F.col("_put"), lambda f, part: f["name"]))
    mapping = F.coalesce(F.array_distinct(F.transform("_put", lambda f: F.struct(f["name"].alias("name"), f["value"].alias("value")))), F.array().cast("array<struct<name:string,value:string>>"))
    return joined.select(*df.columns, cloaked.alias("cloaked"), mapping.alias("mapping"))


def rehydrate(text: Column, mapping: Column) -> Column:
    """The names in the text turned back to the values, the longest names first."""
    ordered = F.array_sort(F.transform(mapping, lambda m: F.struct((-F.length(m["name"])).alias("n"), m["name"].alias("name"), m["value"].alias("value"))))
    return F.aggregate(ordered, text, lambda acc, m: F.replace(acc, m["name"], m["value"]))
