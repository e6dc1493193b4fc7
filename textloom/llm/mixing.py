"""Mixing to target weights with soft domain membership, in DataFrame operations only.

A naive Bayes classifier fitted on a labelled table gives every document a posterior p over domains. Rates r of
documents, not negative and at most ``max_rate``, are then fitted so that the expected tokens of each domain,
sum r n p, match their targets: projected gradient steps on sum_k (tokens_k - target_k)^2. In the metric of the
documents' tokens the gradient is a combination of the posteriors, r - sum_k p_k s_k, so a step is one number s_k a domain,
scaled by the curvature sum n p_j p_k over the documents that it can move, and clipped to the bounds of the rates.

Every word of the labelled documents gives evidence, through a table of ``BUCKETS`` hashes. It is measured within a
language, against the words of the language in all domains: a language that one domain has more of says nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.shared import bound, free_names, held_out, unit_hash, written

BINS = 8
BUCKETS = 1 << 16
#: So many occurrences of a word more count as if they were spread as the language's words are: rare words say little.
PRIOR_COUNT = 10.0
#: So many labelled documents more of a language count as if they were spread over the domains as all are.
PRIOR_DOCS = 5.0


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shares(text: Column, words: Column, distinct: Column) -> list[Column]:
    """Shares of symbols, capitals and distinct words in a text, each put into one of ``BINS`` bins."""
    t = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(t), F.lit(1))
    without = lambda pattern: (size - F.greatest(F.length(F.regexp_replace(t, pattern, "")), F.lit(0))) / size
    shares = F.sqrt(without(r"[#*$%&|<>!]")), without(r"\p{Lu}"), F.size(distinct) / F.greatest(F.size(words), F.lit(1))
    return [F.least(F.floor(s * BINS), F.lit(BINS - 1)).cast("int") for s in shares]


def _bucket(word: Column, lang: Column) -> Column:
    """The place of a word's evidence in its language; of its evidence in any where ``lang`` is null."""
    return F.pmod(F.xxhash64(lang, word), F.lit(BUCKETS)).cast("int")


@dataclass
class DomainModel:
    """Log weights of a naive Bayes classifier, relative to the first domain's; of a fixed size."""

    domains: list[str]
    prior: list[float]
    bins: list[list[list[float]]]  # share, bin, domain
    words: list[list[float]]  # for each domain but the first, the weight of each bucket
    langs: list[str] = field(default_factory=list)
    lang_col: str | None = None
    lang_priors: list[list[float]] = field(default_factory=list)  # in the order of langs

    def word_table(self, spark: SparkSession) -> DataFrame:
        """``words`` as one row: a struct with an array for each domain but the first."""
        kind = ", ".join(f"w{j}: array<double>" for j in range(1, len(self.words) + 1))
        return spark.createDataFrame([((0, *self.words),)], f"words struct<none: int{kind and ', ' + kind}>", verifySchema=False)

    def posterior(self, text: Column, words: Column | None = None) -> Column:
        """``n_tokens`` and the posterior ``p`` (in the order of ``domains``) of a text, as a struct.

        words: a column with the struct of ``word_table``. Else the weights stand in the expression, where each text of
        a plan repeats them (some 2 MB for two tables).
        """
        row = lambda x: F.array(*[F.lit(float(v)) for v in x])
        if words is None:
            # literals of text, which the optimiser turns into arrays once
            words = F.struct(F.lit(0).alias("none"), *[F.split(F.lit(",".join(f"{v:.4g}" for v in ws)), ",").cast("array<double>").alias(f"w{j}") for j, ws in enumerate(self.words, 1)])
        lang = F.when(F.col(self.lang_col).isin(self.langs), F.col(self.lang_col)) if self.langs else F.lit(None).cast("string")
        plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)

        def from_words(words: Column, distinct: Column, weights: Column) -> Column:
            total = row(self.prior)
            if self.lang_priors:
                own = F.create_map(*[x for g, p in zip(self.langs, self.lang_priors, strict=True) for x in (F.lit(g), row(p))])
                total = F.coalesce(F.try_element_at(own, lang), total)
            for share, logs in zip(_shares(text, words, distinct), self.bins, strict=True):
                total = plus(total, F.get(F.array(*[row(x) for x in logs]), share))
            said = lambda at: F.array(F.lit(0.0), *[F.aggregate(at, F.lit(0.0), lambda acc, b: acc + F.get(weights[f"w{j}"], b)) for j in range(1, len(self.words) + 1)])
            total = plus(total, bound(F.transform(distinct, lambda w: _bucket(w, lang)), said))
            likely = lambda s: bound(F.array_max(s), lambda top: F.transform(s, lambda x: F.exp(x - top)))
            even = lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))
            return F.struct(F.size(words).cast("long").alias("n_tokens"), bound(bound(total, likely), even).alias("p"))

        # the weights stand once in the expression, so that the optimiser merges a projection that gives them with this one
        return bound(words, lambda weights: bound(_words(text), lambda all_: bound(F.array_distinct(all_), lambda distinct: from_words(all_, distinct, weights))))


def _word_weights(read: DataFrame, domains: list[str]) -> list[list[float]]:
    """For each domain but the first, the log weight of each bucket. read: ``lang, domain, words`` of the labelled documents.

    All occurrences are counted here, though a text's evidence is that of its distinct words: which words are distinct
    in a short text and in a long one differs even where their words are drawn alike.
    """
    k = range(len(domains))
    if len(domains) < 2:
        return []
    here = [F.sum((F.col("domain") == d).cast("long")).alias(f"n{j}") for j, d in enumerate(domains)]
    counted = written(read.select("lang", "domain", F.explode("words").alias("word")).groupBy("lang", "word").agg(*here), "labelled-words")
    totals = counted.groupBy(F.col("lang").alias("_lang")).agg(*[F.sum(f"n{j}").alias(f"t{j}") for j in k])
    beside = counted.join(totals, F.col("lang").eqNullSafe(F.col("_lang")))
    n, t = sum((F.col(f"n{j}") for j in k), F.lit(0)), sum((F.col(f"t{j}") for j in k), F.lit(0))
    # how much oftener a domain has the word than the language; a domain that the language lacks says nothing
    share = [F.col(f"t{j}") / t for j in k]
    log_p = [F.when(F.col(f"t{j}") == 0, 0.0).otherwise(F.log((F.col(f"n{j}") + PRIOR_COUNT * share[j]) / ((n + PRIOR_COUNT) * share[j]))) for j in k]
    each = beside.select("lang", "word", n.alias("n"), *[(log_p[j] - log_p[0]).alias(f"w{j}") for j in k[1:]])
    # a word's evidence in any language is the mean of that in each; so is that of words that share a bucket
    none = F.lit(None).cast("string")
    both = each.select("n", *[f"w{j}" for j in k[1:]], F.explode(F.array_distinct(F.array(_bucket(F.col("word"), F.col("lang")), _bucket(F.col("word"), none)))).alias("bucket"))
    got = both.groupBy("bucket").agg(*[(F.sum(F.col("n") * F.col(f"w{j}")) / F.sum("n")).alias(f"w{j}") for j in k[1:]]).toArrow()  # BUCKETS rows at most
    out = np.zeros((len(domains) - 1, BUCKETS))
    for j in k[1:]:
        out[j - 1, got["bucket"].to_numpy()] = [float(f"{x:.4g}") for x in got[f"w{j}"].to_numpy()]  # sums differ a little with the order of rows
    return out.tolist()


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], sample_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", lang_col: str | None = None) -> DomainModel:
    """Fit on at most ``sample_rows`` labelled documents, those whose ids hash lowest, with all their words.

    Held-out ids, null ids, null domains and domains not named are left out; of several domains of an id the least
    counts, and of several texts of an id that of the least hash. Without any labelled document every domain is equally
    likely. With ``lang_col`` the evidence of a word is that in the document's language; documents of other languages
    and of null take its mean over languages.
    """
    known = labelled.where(F.col(domain_col).isin(domains) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).groupBy(F.col(id_col).alias("_id")).agg(F.min(domain_col).alias("domain"))
    picked = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    met = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), lang.alias("lang")).join(F.broadcast(picked), "_id")  # sample_rows bounds the broadcast
    texts = met.groupBy("_id", "domain").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "lang")).alias("_t")).select("domain", "_t.text", "_t.lang")
    cut = texts.select("domain", "lang", "text", _words(F.col("text")).alias("all")).select("domain", "lang", "text", "all", F.array_distinct("all").alias("words"))
    read = written(cut.select("domain", "lang", F.col("all").alias("words"), F.array(*_shares(F.col("text"), F.col("all"), F.col("words"))).alias("bins")), "labelled-texts")
    totals = dict.fromkeys(domains, 0) | {r.domain: r.n for r in read.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    n = sum(totals.values())
    of_lang: dict[str, dict[str, int]] = {}
    for r in read.where("lang is not null").groupBy("lang", "domain").agg(F.count("*").alias("n")).collect():  # sample_rows at most
        of_lang.setdefault(r.lang, {})[r.domain] = r.n
    langs = sorted(of_lang)
    here = [F.sum((F.col("domain") == d).cast("long")).alias(f"n{k}") for k, d in enumerate(domains)]
    bins = read.select("domain", F.posexplode_outer("bins").alias("share", "bin")).groupBy("share", "bin").agg(*here).collect()
    table = {(r.share, r.bin): [r[f"n{k}"] for k in range(len(domains))] for r in bins}
    logs = [[[math.log((table.get((s, b), [0] * len(domains))[k] + 0.5) / (totals[d] + 0.5 * BINS)) for k, d in enumerate(domains)] for b in range(BINS)] for s in range(3)]
    prior = [math.log((totals[d] + 1) / (n + len(domains))) for d in domains]
    share = [math.exp(x) for x in prior]
    lang_priors = [[math.log((of_lang[g].get(d, 0) + PRIOR_DOCS * share[k]) / (sum(of_lang[g].values()) + PRIOR_DOCS)) for k, d in enumerate(domains)] for g in langs]
    return DomainModel(list(domains), prior, logs, _word_weights(read, domains), langs if lang_col else [], lang_col, lang_priors if lang_col else [])


@dataclass
class Rates:
    """The fitted rate of a document as a function of its posterior, and what the rates come to."""

    steps: list[list[float]]
    max_rate: float
    tokens_now: list[float]
    targets: list[float]
    tokens: list[float]
    matched: bool = False

    def of(self, p: Column, start: Column | float = 1.0, first: int = 0) -> Column:
        r = F.lit(start) if isinstance(start, float) else start
        for g in self.steps[first:]:
            r = self.after(r, p, g)
        return r

    def after(self, r: Column, p: Column, step: list[float]) -> Column:
        return F.least(F.lit(self.max_rate), F.greatest(F.lit(0.0), r - sum((F.get(p, F.lit(k)) * F.lit(x) for k, x in enumerate(step)), F.lit(0.0))))


def fit_rates(members: DataFrame, weights: list[float], total: float | None = None, max_rate: float = 1.0, most_lost: float = 0.01, iterations: int = 30, tolerance: float = 5e-4) -> Rates:
    """Fit rates to ``members`` (columns ``n_tokens`` and posterior ``p``).

    With ``total`` the targets are ``weights`` of so many tokens. Without one they are feasible ones: the domain of the
    largest weight keeps what it can, and each other is to have its share beside that, or all that it holds at
    ``max_rate`` where that is less. That the first holds its total is an equation of each step like the others, so
    that documents likely of it are spared; no step is taken that costs it more than ``most_lost`` of its tokens in all.
    ``targets`` and ``tokens`` of the result tell how far the others come; ``matched`` is true if each total is within ``tolerance`` of its target. Steps end there, or when none brings the totals nearer, or after
    ``iterations``. A step that brings them no nearer is shortened, or made with the bound 1 for the curvature. Each sums a number for every two domains over all documents.
    """
    k = range(len(weights))
    weights = [w / sum(weights) for w in weights]
    main = max(k, key=lambda j: weights[j])
    moved = list(k)
    p = [F.get("p", F.lit(j)) for j in k]
    n = F.col("n_tokens")

    def sums(df: DataFrame, values: list[Column]) -> list[float]:
        return [float(x or 0) for x in df.agg(*[F.sum(v) for v in values]).first()]

    def after_each(here: DataFrame, steps: list[list[float]]) -> list[list[float]]:
        """The totals after each of several steps, in one pass."""
        tried = here.select("n_tokens", "p", *[rates.after(F.col("_rate"), F.col("p"), g).alias(f"_r{i}") for i, g in enumerate(steps)])
        got = sums(tried, [n * F.col(f"_r{i}") * x for i in range(len(steps)) for x in p])
        return [got[i * len(p) : (i + 1) * len(p)] for i in range(len(steps))]

    def aims(tokens: list[float]) -> list[float]:
        if total is not None:
            return [w * total for w in weights]
        return [tokens[j] if j == main else min(weights[j] / weights[main] * tokens[main], max_rate * now[j]) for j in k]

    def off(tokens: list[float]) -> list[float]:
        return [t - target for t, target in zip(tokens, aims(tokens), strict=True)]

    def cost(tokens: list[float]) -> float:
        return sum(d * d / now[j] for j, d in enumerate(off(tokens)) if now[j] > 0)

    def near(tokens: list[float]) -> bool:
        return all(abs(d) <= tolerance * max(target, 1.0) for d, target in zip(off(tokens), aims(tokens), strict=True))

    now = sums(members, [n * x for x in p])
    rates = Rates([], max_rate, now, [], now)
    kept, first = members.withColumn("_r", F.lit(1.0)), 0
    for _ in range(iterations):
        if near(rates.tokens):
            break
        d = off(rates.tokens)
        # documents whose rates the gradient can move: those at a bound only if it leads inwards
        here = kept.select("n_tokens", "p", rates.of(F.col("p"), F.col("_r"), first).alias("_rate"))
        slope = sum((p[j] * F.lit(d[j] / now[j]) for j in moved if now[j] > 0), F.lit(0.0))
        free = F.when(((F.col("_rate") > 0) | (slope < 0)) & ((F.col("_rate") < max_rate) | (slope > 0)), n)
        got = iter(sums(here, [free * p[i] * p[j] for i in moved for j in moved]))
        curved = np.array([[next(got) for _ in moved] for _ in moved])
        # a domain with nothing to move has no step, and none moves a rate by more than its posterior
        can = np.array([curved[i, i] > 1e-6 * now[j] for i, j in enumerate(moved)])
        whole = np.zeros(len(moved))
        whole[can] = np.clip(np.linalg.lstsq(curved[np.ix_(can, can)], np.array([d[j] for j in moved])[can], rcond=None)[0], -1, 1)
        plain = np.array([d[j] / max(now[j], 1e-9) for j in moved])  # the largest eigenvalue there is at most 1
        steps = []
        for way in (whole, whole / 3, whole / 10, whole / 30, plain / 10):
            steps.append([0.0 for _ in k])
            for j, x in zip(moved, way, strict=True):
                steps[-1][j] = float(x)
        for step, tokens in zip(steps, after_each(here, steps), strict=True):
            spared = total is not None or tokens[main] >= (1 - most_lost) * now[main]
            if spared and cost(tokens) < cost(rates.tokens) * (1 - 1e-3):
                rates.steps.append(step)
                rates.tokens = tokens
                break
        else:
            break
        if len(rates.steps) - first >= 8:  # the expression stays short
            kept = written(kept.withColumn("_r", rates.of(F.col("p"), F.col("_r"), first)), "rates")
            first = len(rates.steps)
    rates.targets, rates.matched = aims(rates.tokens), near(rates.tokens)
    return rates


@dataclass
class Mixture:
    """A fitted mixture. Texts are read once, when ``members`` is written."""

    model: DomainModel
    rates: Rates
    members: DataFrame
    columns: list[str]

    def document_rates(self) -> DataFrame:
        """``doc_id, n_tokens, p, rate, copies`` for every row.

        ``copies`` is the rate rounded down, and one more with the probability of the rest, drawn from the id and the
        text: the same in every run, and for repeated rows.
        """
        rated = self.members.withColumn("rate", self.rates.of(F.col("p")))
        copies = F.floor("rate") + (F.col("u") < F.col("rate") - F.floor("rate")).cast("int")
        return rated.select("doc_id", "n_tokens", "p", "rate", copies.cast("int").alias("copies"), *[c for c in rated.columns if c == "row"])

    def documents(self) -> DataFrame:
        """The documents, all columns whatever their names, each row as often as its copies say."""
        drawn = self.document_rates().where("copies >= 1")
        if self.rates.max_rate > 1:
            drawn = drawn.select("row", F.explode(F.sequence(F.lit(1), "copies")))
        return drawn.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(self.columns)])


def fit_mixture(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", lang_col: str | None = None, max_rate: float = 1.0, keep_rows: bool = False, sample_rows: int = 6000, **options) -> Mixture:
    """Fit the classifier and the rates (``options``: those of ``fit_rates``). ``keep_rows`` is for ``documents()``.

    Null and empty texts have no tokens and the rate of their posterior, which rests on the priors. Very long texts are
    read whole. Repeated rows each count and have one rate; documents of equal posterior do too. An empty table has an
    empty mixture. Without ``keep_rows`` no column but the id, the text and ``lang_col`` is read.
    """
    model = fit_domains(docs, labelled, list(targets), sample_rows, id_col, text_col, domain_col, lang_col)
    inner, words = free_names(docs, "_m", "_words")
    kept = [F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(docs.columns)]).alias("row")] if keep_rows else []
    weighed = docs.withColumn(words, model.word_table(docs.sparkSession).scalar())
    read = weighed.select(F.col(id_col).alias("doc_id"), unit_hash(F.col(id_col), F.col(text_col)).alias("u"), model.posterior(F.col(text_col), F.col(words)).alias(inner), *kept)
    members = written(read.select("doc_id", "u", f"{inner}.n_tokens", f"{inner}.p", *["row" for _ in kept]), "memberships")
    return Mixture(model, fit_rates(members.select("n_tokens", "p"), list(targets.values()), max_rate=max_rate, **options), members, docs.columns)
