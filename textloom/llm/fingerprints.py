"""Document fingerprints: a homomorphic multiset hash of paragraphs, in DataFrame operations only.

A paragraph (what stands between line ends) is hashed to a wide vector, a text's fingerprint is the sum of its
paragraphs' vectors, lane by lane modulo a power of two. So the order of paragraphs doesn't matter, and a text whose
paragraphs change has the old fingerprint less the vectors of those that went plus the vectors of those that came.

A vector has two parts. The ``exact`` one, 16 lanes modulo 2^32, is the paragraph's SHA-512: equal sums mean equal
multisets of paragraphs. The ``like`` part, 128 lanes modulo 2^16, is the sum of a vector of 1 and -1 for each three
words in a row of the paragraph; its inner products estimate those of the texts' counts of such windows, so the cosine
of two of them says how much of the texts is shared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.shared import bound, written

#: Lanes of the exact part (of 32 bits, 8 hexadecimal digits) and of the part for likeness (of 16 bits, 4 digits).
EXACT_LANES, LIKE_LANES = 16, 128
EXACT, LIKE = 1 << 32, 1 << 16
#: Words of a window.
WINDOW = 3
#: Two counters of 32 bits in one long.
_PAIR = (1 << 32) + 1


def paragraphs_of(text: Column) -> Column:
    """Blank ones are paragraphs too; a null or empty text has one, which is empty."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _windows(paragraph: Column) -> Column:
    """Hashes of three words in a row, or of all words of a shorter paragraph."""
    words = F.array_remove(F.split(paragraph, r"[\x09-\x0D ]+"), "")
    at = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - WINDOW, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(WINDOW)]))
    return bound(words, lambda w: F.when(F.size(w) > 0, at(w)))


def paragraph_sums(paragraphs: DataFrame, keys: list[str], paragraph_col: str = "paragraph") -> DataFrame:
    """The summed vectors of the paragraphs of each key: ``exact, like``. A null paragraph counts as an empty one.

    Sums begin where the paragraphs are, so what is shuffled (if the rows aren't dealt by the keys already) is a vector
    a key.
    """
    p = F.coalesce(F.col(paragraph_col), F.lit(""))
    each = paragraphs.select(*keys, F.sha2(p, 512).alias("_sha"), _windows(p).alias("_windows"))
    each = each.select(*keys, "_sha", F.posexplode_outer("_windows").alias("_at", "_h"))
    # the exact lanes once a paragraph, the others once a window; a lane counts the windows whose hash has its bit
    first = F.coalesce(F.col("_at"), F.lit(0)) == 0
    exact = [F.sum(F.when(first, F.conv(F.substring("_sha", 8 * k + 1, 8), 16, 10).cast("long")).otherwise(0)).alias(f"_e{k}") for k in range(EXACT_LANES)]
    hashes = [F.col("_h"), F.xxhash64(F.lit(1), F.col("_h"))]
    bits = [F.sum(F.coalesce(F.shiftrightunsigned(hashes[k // 32], k % 32).bitwiseAND(F.lit(_PAIR)), F.lit(0))).alias(f"_b{k}") for k in range(LIKE_LANES // 2)]
    sums = each.groupBy(*keys).agg(*exact, *bits, F.count("_h").alias("_n"))
    # of n windows c have the bit: the sum of signs is 2c - n
    lanes = [half for k in range(LIKE_LANES // 2) for half in (F.col(f"_b{k}").bitwiseAND(F.lit(EXACT - 1)), F.shiftrightunsigned(f"_b{k}", 32))]
    like = F.array(*[F.pmod(2 * c - F.col("_n"), F.lit(LIKE)) for c in lanes])
    return sums.select(*keys, F.array(*[F.pmod(f"_e{k}", F.lit(EXACT)) for k in range(EXACT_LANES)]).alias("exact"), like.alias("like"))


def combined(sums: Column, other: Column, modulus: int, sign: int = 1) -> Column:
    """Lanes with those of paragraphs that came (1) or went (-1). A null on either side stands for no paragraphs."""
    both = F.zip_with(sums, other, lambda a, b: F.pmod(a + sign * b, F.lit(modulus)))
    return F.coalesce(both, sums, other if sign == 1 else F.transform(other, lambda b: F.pmod(-b, F.lit(modulus))))


def fingerprint(exact: Column, like: Column) -> Column:
    """The lanes as one string of hexadecimal digits, the exact ones first."""
    digits = lambda lanes, n: F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), n, "0")), "")
    return F.concat(digits(exact, 8), digits(like, 4))


def _signed(lanes: Column) -> Column:
    return F.transform(lanes, lambda x: F.when(x >= LIKE // 2, x - LIKE).otherwise(x).cast("double"))


def likeness(like: Column, other: Column, equal: Column) -> Column:
    """The cosine of two parts for likeness, from 0 to 1; 1 where the fingerprints are ``equal``, and 0 for a text without
    words beside a different one."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    cosine = bound(_signed(like), lambda a: bound(_signed(other), lambda b: dot(a, b) / F.nullif(F.sqrt(dot(a, a) * dot(b, b)), F.lit(0.0))))
    return F.when(equal, F.lit(1.0)).otherwise(F.coalesce(F.least(F.greatest(cosine, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, exact, like, fingerprint`` of each row of ``docs``, whole texts.

    Equal texts have equal fingerprints, and so have texts that differ in the order of their paragraphs only. Null and
    empty texts have the fingerprint of one empty paragraph. Rows with null ids and repeated rows have each their own.
    An empty table gives an empty result. Other columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("_row"), paragraphs_of(F.col(text_col)).alias("_all"))
    return paragraph_sums(rows.select("doc_id", "_row", F.explode("_all").alias("paragraph")), ["doc_id", "_row"]).select("doc_id", "exact", "like", fingerprint(F.col("exact"), F.col("like")).alias("fingerprint"))


def update_fingerprints(known: DataFrame, changes: DataFrame) -> DataFrame:
    """``known`` (``doc_id, exact, like``, one row an id) after ``changes``: ``doc_id, sign, paragraph``, with sign 1 for a
    paragraph that came and -1 for one that went. No text is needed. Changes of unknown and of null ids are left out.
    """
    signs = [(1, "came"), (-1, "went")]
    out = known.select("doc_id", "exact", "like")
    for sign, name in signs:
        sums = paragraph_sums(changes.where(F.col("sign") == sign).select("doc_id", "paragraph"), ["doc_id"])
        out = out.join(sums.select("doc_id", F.col("exact").alias(f"_exact_{name}"), F.col("like").alias(f"_like_{name}")), "doc_id", "left")
        out = out.select("doc_id", *[combined(F.col(c), F.col(f"_{c}_{name}"), m, sign).alias(c) for c, m in (("exact", EXACT), ("like", LIKE))])
    return out.select("*", fingerprint(F.col("exact"), F.col("like")).alias("fingerprint"))


def next_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, next_id, n_chars`` of each id: the largest smaller one, and the largest of all after the smallest.
    ``n_chars`` is the most that a row of the id has. Null ids have no place in this order.

    Only ids are sorted and moved: by range, then within each range, then from range to range.
    """
    ids = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.length(F.coalesce(F.col(text_col), F.lit("")))).cast("long").alias("n_chars"))
    ranges = written(ids.repartitionByRange("doc_id").select("doc_id", "n_chars", F.spark_partition_id().alias("part")), "ids-by-range")
    below = F.lag("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    # one row a range; its least id's next is the most of the range before, and the least of all has the most of all
    ends = ranges.groupBy("part").agg(F.max("doc_id").alias("most"))
    ring = ends.select("part", F.coalesce(F.lag("most").over(Window.orderBy("part")), F.max("most").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    return ranges.select("doc_id", "n_chars", "part", below.alias("below")).join(ring, "part").select("doc_id", F.coalesce("below", "before").alias("next_id"), "n_chars")


def _edited(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id, row, text, begun`` of each row, ``begun`` being what the next document's text begins with; and ``doc_id,
    next_exact, next_like``, the vectors of the next document."""
    # names that the source can't have: a column kept under its own name is one thing in one branch of a plan and another
    # in the other, and the joins below would each deal the texts
    placed = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).where("_doc is not null")
    links = next_ids(docs, id_col, text_col)
    # merged joins at every size: the texts are dealt by id once, for giving and for taking
    wanted = links.select(F.col("next_id").alias("_doc"), F.col("doc_id").alias("to_id"), F.floor(F.col("n_chars") / 2).cast("int").alias("most")).hint("merge")
    given = placed.join(wanted, "_doc").groupBy("_doc").agg(F.min(F.struct(F.xxhash64("_text").alias("h"), F.col("_text").alias("text"), "most", "to_id")).alias("_g")).select("_g.*")
    taken = given.select(F.col("to_id").alias("_doc"), F.expr("left(text, most)").alias("begun")).hint("merge")
    vectors = paragraph_sums(given.select("to_id", F.explode(paragraphs_of(F.col("text"))).alias("paragraph")), ["to_id"])
    rows = placed.join(taken, "_doc", "left").select(F.col("_doc").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col("_text").alias("text"), "begun")
    return rows, vectors.select(F.col("to_id").alias("doc_id"), F.col("exact").alias("next_exact"), F.col("like").alias("next_like"))


def _edit_sums(rows: DataFrame) -> DataFrame:
    """For each row the fingerprint and the edited text's, by what stays, goes and comes."""
    n = F.length("text")
    kept = F.expr("left(text, length(text) - length(text) div 2)")
    new = F.concat(kept, F.coalesce(F.expr("left(begun, length(text) div 2)"), F.lit("")))
    cut = rows.select("doc_id", "row", n.cast("long").alias("n_chars"), paragraphs_of(F.col("text")).alias("old"), F.size(paragraphs_of(kept)).alias("line"), new.alias("edited"))
    cut = cut.select("doc_id", "row", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "old", "line", paragraphs_of(F.col("edited")).alias("new"))
    # whole paragraphs before the one that is cut stay; parts are 0 for what stays, 1 for what goes and 2 for what comes
    marked = lambda part, paragraphs: F.transform(paragraphs, lambda p: F.struct(F.lit(part).alias("part"), p.alias("paragraph")))
    rest = lambda name: F.slice(name, F.col("line"), F.greatest(F.size(name) - F.col("line") + 1, F.lit(0)))
    each = F.explode(F.concat(marked(0, F.slice("old", F.lit(1), F.col("line") - 1)), marked(1, rest("old")), marked(2, rest("new"))))
    keys = ["doc_id", "row", "n_chars", "edited_sha256"]
    sums = paragraph_sums(cut.select(*keys, each.alias("_p")).select(*keys, "_p.part", "_p.paragraph"), [*keys, "part"])
    of = lambda part, name: F.max(F.when(F.col("part") == part, F.col(name)))
    parts = sums.groupBy(*keys).agg(*[of(p, c).alias(f"_{c}{p}") for p in range(3) for c in ("exact", "like")])
    lanes = lambda c, m, change: combined(F.col(f"_{c}{change}"), F.col(f"_{c}0"), m)
    return parts.select(*keys, *[lanes(c, m, k).alias(name + c) for k, name in ((1, ""), (2, "edited_")) for c, m in (("exact", EXACT), ("like", LIKE))])


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` of every row.

    The edited text has the last ``floor(n_chars / 2)`` code points replaced by the first as many (or all) of the next
    document, in descending order of ids, the first after the last. Its fingerprint is made of the text's: the vectors
    of the paragraphs from the cut on go, those of the new ones come.

    A null text is an empty one. Rows with null ids have no next document: nothing comes, and ``near_next`` is the
    likeness to an empty text. Of several rows of an id the one whose text hashes least is the next of the id before;
    each has its own edited text. A table of one id has itself as the next. An empty table gives an empty result. Very
    long texts are read whole. Other columns aren't read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    without = rows.where("doc_id is null").select("doc_id", "row", "text", F.lit("").alias("begun"))
    edited, vectors = _edited(docs, id_col, text_col)
    empty = F.array(*[F.conv(F.substring(F.sha2(F.lit(""), 512), 8 * k + 1, 8), 16, 10).cast("long") for k in range(EXACT_LANES)])
    none = F.array_repeat(F.lit(0).cast("long"), LIKE_LANES)
    placed = _edit_sums(edited).join(vectors.hint("merge"), "doc_id")
    done = placed.unionByName(_edit_sums(without).select("*", empty.alias("next_exact"), none.alias("next_like")))
    near = lambda exact, like: likeness(F.col("like"), F.col(like), (F.col("exact") == F.col(exact)) & (F.col("like") == F.col(like)))
    return done.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("exact"), F.col("like")).alias("fingerprint"),
        fingerprint(F.col("edited_exact"), F.col("edited_like")).alias("edited_fingerprint"),
        near("edited_exact", "edited_like").alias("near_edited"),
        near("next_exact", "next_like").alias("near_next"),
    )
