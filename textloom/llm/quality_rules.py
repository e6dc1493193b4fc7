"""Quality rules: robust multivariate outliers, in DataFrame operations only.

Each text has a vector of transformed statistics. For every language and source (and, for small ones, every language
and the whole table) a minimum-covariance-determinant estimate is made by concentration steps from three starts: the
rows nearest to the centre give the next centre and covariance, and the start of the least determinant counts. A text
is rejected if its squared Mahalanobis distance is over a quantile of chi-squared.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.shared import bound, discard, written

BLANK = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: The transformed statistics: words n as n / (n + 300), log mean word length, root of the share of symbols, and the
#: shares of repeated lines and of repeated words, as lower bounds of what so few lines and words show.
VECTOR = ("length", "word_length", "symbol_share", "dup_line_share", "repeat_share")
D = len(VECTOR)
#: Most texts have shares of 0, which leaves covariances singular. Its square is added to each variance.
RESOLUTION = 0.05
STARTS = 3
#: Squared distances are compared on this many steps per doubling, which bounds what a quantile must count.
STEPS = 64


def chi_squared_quantile(level: float, d: int = D) -> float:
    """The value that chi-squared with ``d`` degrees of freedom stays below with probability ``level``."""

    def below(x: float) -> float:
        term = total = (x / 2) ** (d / 2) * math.exp(-x / 2) / math.gamma(d / 2 + 1)
        k = 0
        while term > total * 1e-16 and k < 10_000:
            k += 1
            term *= x / (d + 2 * k)
            total += term
        return total

    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < level else (low, middle)
    return high


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words`` of every whole text; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    without = lambda x, chars: F.length(F.translate(x, chars, ""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    words = F.array_remove(F.split(text, BLANK), "")
    first = docs.select(F.col(id_col).alias("doc_id"), *more, words.alias("_words"), lines.alias("_lines"), without(text, BLANKS).alias("word_chars"), (F.length(text) - without(text, SYMBOLS)).alias("n_symbols"))
    here = F.col("_words")
    # a window is one number: the leading bits of its hash, and its place in as many bits as places need
    bits = F.greatest(F.ceil(F.log2(F.size(here) + 1)), F.lit(1)).cast("int")
    shift = lambda name, x, n: F.call_function(name, x, n)

    def hashes(w: Column) -> Column:
        return F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))

    second = first.select("doc_id", *more, "word_chars", "n_symbols", bits.alias("_bits"), "_words", F.size("_words").alias("n_words"), F.size("_lines").alias("n_lines"), F.size(F.array_distinct("_lines")).alias("_distinct"), bound(here, hashes).alias("_hashes"))
    packed = F.sort_array(F.transform("_hashes", lambda x, i: shift("shiftleft", shift("shiftright", x, F.col("_bits")), F.col("_bits")) + i))
    # most texts repeat no window
    again = F.size(F.array_distinct("_hashes")) < F.size("_hashes")
    second = second.withColumn("_windows", F.when(again, packed).otherwise(F.array().cast("array<bigint>"))).drop("_hashes")
    place = lambda x: (x - shift("shiftleft", shift("shiftright", x, F.col("_bits")), F.col("_bits"))).cast("int")

    def repeated(sorted_: Column) -> Column:
        same = lambda x, y: shift("shiftright", x, F.col("_bits")).eqNullSafe(shift("shiftright", y, F.col("_bits")))
        return F.transform(F.filter(sorted_, lambda x, i: same(x, F.get(sorted_, i + 1)) | same(x, F.get(sorted_, i - 1))), place)

    # leading bits may be equal by chance: windows that meet are told apart by their words
    met = second.withColumn("_met", bound(F.col("_windows"), repeated)).drop("_windows", "_bits")
    spelled = F.transform("_met", lambda i: F.struct(F.slice("_words", i + 1, F.lit(3)).alias("w"), i.alias("i")))
    sure = bound(spelled, lambda each: F.when(F.size(each) > 0, bound(F.sort_array(each), lambda s: F.filter(s, lambda x, k: F.get(s, k - 1)["w"].eqNullSafe(x["w"]) | F.get(s, k + 1)["w"].eqNullSafe(x["w"])))).otherwise(each))
    covered = F.size(F.array_distinct(F.flatten(F.transform(sure, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return met.select("doc_id", *more, *[F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_lines")], (F.col("n_lines") - F.col("_distinct")).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _at_least(k: Column, n: Column) -> Column:
    """The share k of n shows at least (Wilson's lower bound, two standard deviations)."""
    n = F.greatest(n.cast("double"), F.lit(1e-9))
    p, z = k / n, 2.0
    return F.greatest(F.lit(0.0), (p + z * z / (2 * n) - z * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / n + z * z / (4 * n * n))) / (1 + z * z / n))


def _vector() -> list[Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    # words repeat in runs: ten of them count as one
    each = F.col("n_words") / (F.col("n_words") + 300), F.log(chars / words), F.sqrt(F.col("n_symbols") / chars), _at_least(F.col("n_dup_lines"), F.col("n_lines")), _at_least(F.col("n_repeat_words") / 10, F.col("n_words") / 10)
    return [x.cast("double").alias(name) for x, name in zip(each, VECTOR, strict=True)]


def inverse(matrix: Column, d: int = D) -> Column:
    """Inverse and log determinant of a positive definite matrix (rows one after another), by Gauss-Jordan steps."""

    def step(acc: Column, k: Column) -> Column:
        m = acc["m"]
        p = F.get(m, k * (d + 1))

        def cell(at: Column) -> Column:
            r, c = F.floor(at / d).cast("int"), at % d
            row, col = F.get(m, r * d + k), F.get(m, k * d + c)
            return F.when((r == k) & (c == k), 1 / p).when(r == k, col / p).when(c == k, -row / p).otherwise(F.get(m, at) - row * col / p)

        return F.struct(F.transform(F.sequence(F.lit(0), F.lit(d * d - 1)), cell).alias("m"), (acc["ld"] + F.log(p)).alias("ld"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(d - 1)), F.struct(matrix.alias("m"), F.lit(0.0).alias("ld")), step)


def _distance() -> Column:
    """Squared Mahalanobis distance from the columns ``mean`` and ``inv``."""
    away = [F.col(x) - F.get("mean", F.lit(i)) for i, x in enumerate(VECTOR)]
    total = F.lit(0.0)
    for i in range(D):
        for j in range(i, D):
            total = total + away[i] * away[j] * F.get("inv", F.lit(i * D + j)) * (1 if i == j else 2)
    return F.greatest(total, F.lit(0.0))


def _step_of(squared: Column) -> Column:
    return F.floor(F.log2(squared + 1e-6) * STEPS)


def _estimate(rows: DataFrame, keys: list[str], names: tuple[str, ...] = VECTOR) -> DataFrame:
    """Mean and inverse covariance of the rows of each group, and the covariance's log determinant."""
    cov = [[F.covar_pop(names[min(i, j)], names[max(i, j)]) + (RESOLUTION**2 if i == j else 0) for j in range(D)] for i in range(D)]
    got = rows.groupBy(*keys).agg(F.array(*[F.avg(x) for x in names]).alias("mean"), F.array(*[c for row in cov for c in row]).alias("cov"))
    return got.withColumn("_inv", inverse(F.col("cov"))).select(*keys, "mean", F.col("_inv.m").alias("inv"), F.col("_inv.ld").alias("log_det"))


def _starts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, start, mean, inv``: the medians as the centre, with the median absolute deviations, and with the
    covariances of the standardised rows' directions and of their hyperbolic tangents."""
    grid = 64  # values are counted on a grid, so that a median needs bounded memory and is the same in every run
    on = lambda: [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    at = lambda c, x: F.percentile(F.round(x * grid), 0.5) / grid
    medians = written(rows.groupBy(*keys).agg(F.array(*[at(x, F.col(x)) for x in VECTOR]).alias("mean")), "medians")
    apart = rows.join(_renamed(medians, keys), on()).groupBy(*keys).agg(F.array(*[at(x, F.abs(F.col(x) - F.get("mean", F.lit(i)))) * 1.4826 for i, x in enumerate(VECTOR)]).alias("_mad"))
    spread = written(apart.join(_renamed(medians, keys), on()).select(*keys, "mean", F.transform("_mad", lambda x: F.sqrt(x * x + RESOLUTION**2)).alias("_s")), "spreads")
    z = [(F.col(x) - F.get("mean", F.lit(i))) / F.get("_s", F.lit(i)) for i, x in enumerate(VECTOR)]
    far = F.sqrt(sum((x * x for x in z), F.lit(0.0)))
    scaled = rows.join(_renamed(spread, keys), on()).select(*keys, *[x.alias(n) for x, n in zip(z, VECTOR, strict=True)], F.greatest(far, F.lit(1e-9)).alias("_far"))
    both = scaled.select(*keys, F.explode(F.array(*[F.struct(F.lit(k).alias("start"), *[f(F.col(n)).alias(n) for n in VECTOR]) for k, f in ((1, lambda x: x / F.col("_far")), (2, F.tanh))])).alias("_v")).select(*keys, "_v.*")
    found = _estimate(both, [*keys, "start"]).drop("mean").join(_renamed(spread, keys), on())
    # from the scale of the standardised rows to that of the rows
    back = F.transform("inv", lambda v, i: v / F.get("_s", F.floor(i / D).cast("int")) / F.get("_s", i % D))
    plain = F.array(*[1 / (F.get("_s", F.lit(i)) * F.get("_s", F.lit(i))) if i == j else F.lit(0.0) for i in range(D) for j in range(D)])
    made = written(spread.select(*keys, F.lit(0).alias("start"), "mean", plain.alias("inv")).union(found.select(*keys, "start", "mean", back.alias("inv"))), "mcd-starts")
    discard(medians, spread)
    return made


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in df.columns if c not in keys])


def fit_mcd(rows: DataFrame, keys: list[str], coverage: float = 0.75, steps: int = 6) -> DataFrame:
    """``keys, n, mean, inv, log_det, scale`` for each group of ``rows`` (which has the columns of ``VECTOR``).

    Each concentration step keeps the share ``coverage`` of rows that are nearest and can't enlarge the determinant;
    steps end when none falls any more, or after ``steps``. Of the starts the one of the least determinant counts.
    ``scale`` brings a median squared distance above that of chi-squared down to it; distances are never enlarged.
    """
    inner = [*keys, "start"]
    on = lambda ks: [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in ks]
    now, total = _starts(rows, keys), math.inf
    each = rows.withColumn("start", F.explode(F.array(*[F.lit(k) for k in range(STARTS)])))
    for _ in range(steps):
        far = each.join(_renamed(now.select(*inner, "mean", "inv"), inner), on(inner)).select(*inner, *VECTOR, _step_of(_distance()).alias("_step"))
        bounds = far.groupBy(*inner).agg(F.percentile("_step", coverage).alias("_bound"))
        near = far.join(_renamed(bounds, inner), on(inner)).where(F.col("_step") <= F.col("_bound"))
        after = written(_estimate(near, inner), "mcd")
        discard(now)
        now, before = after, total
        total = now.agg(F.sum("log_det")).first()[0] or 0.0
        if total > before - 1e-6:
            break
    best = now.groupBy(*keys).agg(F.min(F.struct("log_det", "start", "mean", "inv")).alias("_b")).select(*keys, "_b.*")
    middle = rows.join(_renamed(best, keys), on(keys)).groupBy(*keys).agg(F.count("*").alias("n"), F.percentile(_step_of(_distance()), 0.5).alias("_m"))
    scale = F.greatest(F.pow(F.lit(2.0), F.col("_m") / STEPS) / chi_squared_quantile(0.5), F.lit(1.0))
    made = written(middle.select(*keys, "n", scale.alias("scale")).join(_renamed(best, keys), on(keys)).select(*keys, "n", "mean", "inv", "log_det", "scale"), "mcd")
    discard(now)
    return made


def judge_quality(docs: DataFrame, level: float = 0.999, min_rows: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``doc_id``, the base statistics, ``base_failed, distance, kept`` for every row.

    ``kept`` is false for texts that fail a base rule (under 50 words, or more than half of the words in repeated
    three-word windows) and for those whose squared robust distance is over the quantile ``level`` of chi-squared.
    Estimates come from the texts that pass the base rules, of the same language and source if they are ``min_rows`` or
    more, else of the same language, else of all; null languages and sources are values like others. With no such text
    at all the base rules decide alone.

    Null and empty texts have no words and fail. Very long texts are read whole. Texts of equal statistics are judged
    alike. Repeated rows are each judged and each count. An empty table gives an empty result. Other columns aren't read.
    """
    cutoff = chi_squared_quantile(level)
    read = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"))
    stats = text_statistics(read, "doc_id", "text", "lang", "source").withColumn("base_failed", base_failed())
    stats = written(stats.select("*", *_vector()), "text-statistics")
    levels = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), (F.col("lang") if k < 2 else F.lit(None).cast("string")).alias("g_lang"), (F.col("source") if k < 1 else F.lit(None).cast("string")).alias("g_source")) for k in range(3)])).alias("_g")
    each = stats.where("not base_failed").select(levels, *VECTOR).select("_g.*", *VECTOR)
    fitted = fit_mcd(each, ["level", "g_lang", "g_source"])
    model = lambda k: fitted.where((F.col("level") == k) & ((F.col("n") >= min_rows) | (F.lit(k) == 2))).select(F.col("g_lang").alias(f"_lang{k}"), F.col("g_source").alias(f"_source{k}"), F.struct("mean", "inv", "scale").alias(f"_m{k}"))
    # three models at most are put beside a group; the first there is counts
    groups = stats.select("lang", "source").distinct().withColumn("_all", F.lit(2))
    chosen = groups.join(model(0), F.col("lang").eqNullSafe(F.col("_lang0")) & F.col("source").eqNullSafe(F.col("_source0")), "left").join(model(1), F.col("lang").eqNullSafe(F.col("_lang1")), "left").join(model(2).withColumn("_level", F.lit(2)), F.col("_all") == F.col("_level"), "left")
    chosen = written(chosen.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.coalesce("_m0", "_m1", "_m2").alias("_m")).select("_lang", "_source", "_m.mean", "_m.inv", "_m.scale"), "mcd-by-group")
    discard(fitted)
    beside = stats.join(chosen, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").withColumn("distance", _distance() / F.col("scale"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return beside.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", kept.alias("kept"))
