"""Line dedup by deletion neighbourhoods, in DataFrame operations only; lines one edit apart count as equal.

Equal lines are one line from the start, with its earliest place. Two lines x, y of equal length are one substitution
apart exactly if they share a variant (i, x without character i); y of length m + 1 is one insertion from x exactly
if x is one of y's variants without a character. So in a group of equal variants all substitution lines are near each
other, and all longer lines are near the one shorter: comparing each with the earliest is enough, and no pairs within
a group are made.

A line of n characters has n variants of n characters, so variants are made only where a partner can be, and only of
the part that differs: one edit leaves the first or the last half of a line as it is. Lines are halved over and over,
keeping those whose unchanged half another line shares, until what is left is short.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import discard, free_names, written

#: Parts of no more characters get variants.
SHORT = 48
BLANKS = " \t\r\f\x0b\xa0"


def _lines(docs: DataFrame, *more: Column) -> DataFrame:
    """Every line that isn't blank, trimmed: ``doc_id, row_key, n_lines, line_no, line``; a null line for a row without any."""
    text = F.coalesce(F.col("text"), F.lit(""))
    each = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line_no"), F.btrim(x, F.lit(BLANKS)).alias("line")))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1)
    # what is computed from the whole text comes first: beside the explode it would be computed for each line
    row = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), n_lines.alias("n_lines"), F.filter(each, lambda x: x["line"] != "").alias("_lines"))
    return row.select("doc_id", "row_key", "n_lines", F.explode_outer("_lines").alias("_x")).select("doc_id", "row_key", "n_lines", "_x.line_no", "_x.line")


def _names(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h"), F.xxhash64(line, F.lit(1)).alias("g")]


def _half_keys(line: Column) -> Column:
    """Keys of the unchanged halves: as the shorter line of a pair (class n) and as the longer one (class n - 1)."""
    n = F.length(line)
    out = []
    for role, m in (("short", n), ("long", n - 1)):
        p = F.floor(m / 2).cast("int")
        out += [F.struct(F.xxhash64(F.lit(side), m, part(p)).alias("k"), F.lit(role == "short").alias("short"), F.lit(side == "head").alias("head")) for side, part in (("head", lambda p: F.substring(line, F.lit(1), p)), ("tail", lambda p: F.right(line, p)))]
    return F.array(*out)


def _with_partner(rows: DataFrame) -> DataFrame:
    """Rows whose key ``k`` another row shares, one of the group being the shorter line."""
    met = rows.groupBy("k").agg(F.count("*").alias("_n"), F.max("short").alias("_s")).where("_n > 1 and _s").select("k")
    # the keys grow with the lines, so they are never broadcast; a table of their own lets Spark split a frequent one
    return rows.join(written(met, "shared-halves").hint("merge"), "k", "left_semi")


def _halved(rows: DataFrame) -> DataFrame:
    p = F.floor(F.col("m") / 2).cast("int")
    size = F.length("r")
    head = F.struct(F.xxhash64("k", F.lit("head"), F.substring("r", F.lit(1), p)).alias("k"), F.substring(F.col("r"), p + 1, size).alias("r"))
    tail = F.struct(F.xxhash64("k", F.lit("tail"), F.right("r", p)).alias("k"), F.substring(F.col("r"), F.lit(1), size - p).alias("r"))
    return rows.select("h", "g", "o", "short", (F.col("m") - p).cast("int").alias("m"), F.explode_outer(F.array(head, tail)).alias("_c")).select("h", "g", "o", "short", "m", "_c.k", "_c.r")


def _variants(rows: DataFrame) -> DataFrame:
    """``v`` (hash of a variant), ``kind`` and the line's names and place."""
    without = lambda i: F.concat(F.substring(F.col("r"), F.lit(1), i), F.substring(F.col("r"), i + 2, F.length("r")))
    places = F.when(F.length("r") > 0, F.sequence(F.lit(0), F.length("r") - 1)).otherwise(F.array().cast("array<int>"))
    as_ = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("v"))
    changed = F.transform(places, lambda i: as_("changed", F.xxhash64("k", F.lit("x"), i, without(i))))
    self_ = F.array(as_("shorter", F.xxhash64("k", F.lit("d"), "r")))
    deleted = F.transform(places, lambda i: as_("longer", F.xxhash64("k", F.lit("d"), without(i))))
    each = F.when(F.col("short"), F.concat(self_, changed)).otherwise(F.array_distinct(deleted))
    return rows.select("h", "g", "o", F.explode_outer(each).alias("_v")).select("h", "g", "o", "_v.kind", "_v.v")


def _near_lines(lines: DataFrame, first: DataFrame, min_chars: int) -> DataFrame:
    """``h, g`` of lines that have an earlier line one edit away."""
    keyed = first.where(F.col("n") >= min_chars).select("h", "g", F.explode_outer("halves").alias("_k")).select("h", "g", "_k.*")
    halves = written(_with_partner(keyed), "line-halves")
    places = written(first.select("h", "g", "o", "n").join(halves.select("h", "g").distinct().hint("merge"), ["h", "g"], "left_semi"), "line-places")
    wanted = places.select("o.doc_id", "o.row_key", "o.line_no").hint("merge")
    texts = written(lines.join(wanted, ["doc_id", "row_key", "line_no"], "left_semi").select(*_names(F.col("line")), "line").distinct(), "line-texts")
    chosen = halves.join(places, ["h", "g"])
    m = F.when(F.col("short"), F.col("n")).otherwise(F.col("n") - 1)
    p = F.floor(m / 2).cast("int")
    rest = F.when(F.col("head"), F.substring(F.col("line"), p + 1, F.length("line"))).otherwise(F.substring(F.col("line"), F.lit(1), F.length("line") - p))
    rows = written(chosen.join(texts, ["h", "g"]).select("h", "g", "o", "short", (m - p).cast("int").alias("m"), "k", rest.alias("r")), "line-parts")
    parts = [rows]
    done = [rows.where(F.col("m") <= SHORT)]
    # each round halves what differs: as many rounds as the longest line with a partner has doublings
    while not (rows := rows.where(F.col("m") > SHORT)).isEmpty():
        rows = written(_with_partner(_halved(rows)), "line-parts")
        parts.append(rows)
        done.append(rows.where(F.col("m") <= SHORT))
    short = done[0]
    for more in done[1:]:
        short = short.unionByName(more)
    variants = written(_variants(short), "line-variants")
    at = F.struct("o", "h", "g")
    group = variants.groupBy("v").agg(F.count("*").alias("_n"), F.min(F.when(F.col("kind") != "longer", at)).alias("_short"), F.min(F.when(F.col("kind") == "longer", at)).alias("_long")).where("_n > 1").drop("_n")
    other = F.when(F.col("kind") == "shorter", F.col("_long")).otherwise(F.col("_short"))
    pairs = variants.join(group, "v").select("h", "g", "o", other.alias("_e")).where(F.col("_e.o") < F.col("o")).select("h", "g", F.col("_e.h").alias("eh"), F.col("_e.g").alias("eg")).distinct()
    earlier = texts.select(F.col("h").alias("eh"), F.col("g").alias("eg"), F.col("line").alias("_earlier"))
    # hashes may collide: the distance decides, in time linear in the line for so small a bound
    sure = pairs.join(texts, ["h", "g"]).join(earlier, ["eh", "eg"]).where(F.levenshtein("line", "_earlier", 1) == 1)
    made = written(sure.select("h", "g").distinct(), "near-lines")
    discard(halves, places, texts, *parts, variants)
    return made


def line_decisions(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, row_key, n_lines, repeated, near``: the lines that go, as sorted numbers from 0, of each document.

    Lines are the parts between newlines, trimmed; blank ones stay. A line goes as ``repeated`` if an equal line
    comes earlier, and as ``near`` if its earliest occurrence has an earlier line one edit away (a character put in,
    taken out or changed) and both have ``min_chars`` characters or more. Earlier is by id, then text hash for texts
    that share an id, then line.

    Lines are judged against all of those before them, gone or not. Very long lines and texts are read whole. Rows with null or empty text have no lines to
    lose; rows without an id lose none and no line is compared with theirs. Repeated rows share one row of the
    result. An empty table gives an empty result. Other columns aren't read.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    lines = _lines(docs)
    known = lines.where("line is not null and doc_id is not null")
    place = F.struct("doc_id", "row_key", "line_no").alias("o")
    first = written(known.select(*_names(F.col("line")), F.length("line").alias("n"), place, _half_keys(F.col("line")).alias("halves")).groupBy("h", "g", "n").agg(F.min(F.struct("o", "halves")).alias("_f")).select("h", "g", "n", "_f.o", "_f.halves"), "lines")
    near = _near_lines(known, first, min_chars).withColumn("_near", F.lit(True))
    judged = written(first.select("h", "g", "o").join(near, ["h", "g"], "left").select("h", "g", F.col("o").alias("_o"), F.coalesce("_near", F.lit(False)).alias("_near")), "judged-lines")
    discard(first)
    named = lines.select("doc_id", "row_key", "n_lines", "line_no", *[F.when(F.col("doc_id").isNotNull(), c).alias(a) for c, a in zip((F.xxhash64("line"), F.xxhash64("line", F.lit(1))), ("h", "g"), strict=True)])
    beside = named.join(judged, ["h", "g"], "left").select("doc_id", "row_key", "n_lines", "line_no", (F.struct("doc_id", "row_key", "line_no") != F.col("_o")).alias("_again"), "_near")
    numbers = lambda condition: F.array_sort(F.collect_set(F.when(condition, F.col("line_no"))))
    return beside.groupBy("doc_id", "row_key", "n_lines").agg(numbers(F.coalesce("_again", F.lit(False))).alias("repeated"), numbers(F.col("_near") & ~F.col("_again")).alias("near"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns whatever their names, with the lines taken out that ``line_decisions`` says go.

    Rows are found by id and text hash together. Null texts stay null, rows without an id stay as they are, repeated
    rows lose the same lines, and an empty table stays empty.
    """
    id_name, row, lines = free_names(docs, "_id", "_row", "_gone")
    gone = line_decisions(docs, min_chars, id_col, text_col).select(F.col("doc_id").alias(id_name), F.col("row_key").alias(row), F.concat("repeated", "near").alias(lines)).where(F.size(lines) > 0)
    rest = F.array_join(F.filter(F.split(docs[text_col], "\n"), lambda x, i: ~F.array_contains(gone[lines], i)), "\n")
    joined = docs.join(gone, (docs[id_col] == gone[id_name]) & (F.xxhash64(docs[id_col], docs[text_col]) == gone[row]), "left")
    return joined.select(*[(F.when(gone[lines].isNotNull(), rest).otherwise(docs[c]).alias(c) if c == text_col else docs[c]) for c in docs.columns])
