"""Language identification: naive Bayes over character n-grams in joins, and a linear model over hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

#: Profiles of no more rows go to the tasks as arrays; larger ones meet the n-grams of documents in a join.
PROFILE_ROWS = 1_000_000
#: Chunks and words that a task remembers, and bytes of text that it takes at once.
_REMEMBERED, _STRETCH = 100_000, 1 << 20


def normalised(text: Column) -> Column:
    """Lower case, white space joined, links, mail addresses and words with digits left out, a blank at either end."""
    # word by word: one pattern over the text would try each word from each of its characters
    bare = F.array_join(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: ~w.rlike("://|@|[0-9]")), " ")
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(bare, r"[^\p{L}]+", " ")), F.lit(" "))


def char_ngrams(text: Column, sizes: tuple[int, ...] = (1, 2, 3)) -> Column:
    """All n-grams of the characters, each as often as it occurs; those of one blank left out."""

    def of_size(c: Column, n: int) -> Column:
        # of the characters as an array: a substring would count from the text's start each time
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(c) - n, F.lit(0))), lambda i: F.concat(*[F.get(c, i + j) for j in range(n)]))

    made = lambda c: F.flatten(F.array(*[of_size(c, n) for n in sizes]))
    return F.filter(F.get(F.transform(F.array(F.split(text, "")), made), F.lit(0)), lambda g: F.trim(g) != "")


def gram_counts(docs: DataFrame, *keys: str, text_col: str = "text", sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``keys, gram, n``. Words are counted first and then cut, each with a blank on either side; beside the n-grams in
    those a text has, of the sizes up to 3, only the ones that join the last letter of a word and the first of the next."""
    if max(sizes) > 3:
        each = docs.select(*keys, F.explode_outer(char_ngrams(normalised(F.col(text_col)), sizes)).alias("gram")).where("gram is not null")
        return each.groupBy(*keys, "gram").agg(F.count("*").alias("n"))
    as_ = lambda word, s: F.struct(F.lit(word).alias("word"), s.alias("s"))
    words = F.array_remove(F.split(normalised(F.col(text_col)), " "), "")
    joints = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: as_(False, F.concat(F.right(x, F.lit(1)), F.lit(" "), F.left(F.get(w, i + 1), F.lit(1)))))
    both = lambda w: F.concat(F.transform(w, lambda x: as_(True, x)), *([joints(w)] if 3 in sizes else []))
    parts = docs.select(*keys, F.explode_outer(F.get(F.transform(F.array(words), both), F.lit(0))).alias("_p")).select(*keys, "_p.word", "_p.s").where("s is not null")
    counted = parts.groupBy(*keys, "word", "s").agg(F.count("*").alias("_n"))
    grams = F.when(F.col("word"), char_ngrams(F.concat(F.lit(" "), F.col("s"), F.lit(" ")), sizes)).otherwise(F.array("s"))
    return counted.select(*keys, "_n", F.explode_outer(grams).alias("gram")).where("gram is not null").groupBy(*keys, "gram").agg(F.sum("_n").alias("n"))


class WordPool:
    """The words of every chunk of lower-cased text met, and the n-grams (up to 3) of every word: with ``known`` the places
    of those alone, else each gets a place. A chunk is what stands between blanks, as in ``normalised``."""

    def __init__(self, sizes: tuple[int, ...], known: dict[str, int] | None = None):
        self.sizes, self.fixed, self.places = sizes, known is not None, {} if known is None else known
        self.clear()

    def clear(self) -> None:
        self.of: dict[bytes, int] = {}
        self.first, self.count, self.entry = [], [], []
        self.words: dict[str, int] = {}
        self.head, self.tail, self.grams, self.owner = [], [], [], []

    def full(self) -> bool:
        return len(self.of) > _REMEMBERED

    def place(self, gram: str) -> int | None:
        return self.places.get(gram) if self.fixed else self.places.setdefault(gram, len(self.places))

    def _word(self, word: str) -> int:
        at = self.words.get(word)
        if at is None:
            at = self.words[word] = len(self.head)
            self.head.append(ord(word[0]))
            self.tail.append(ord(word[-1]))
            padded = f" {word} "
            for n in self.sizes:
                for i in range(len(padded) - n + 1):
                    gram = padded[i : i + n]
                    if gram != " " and (k := self.place(gram)) is not None:
                        self.grams.append(k)
                        self.owner.append(at)
        return at

    def _add(self, chunk: bytes) -> int:
        text = chunk.decode()
        self.first.append(len(self.entry))
        if "@" not in text and "://" not in text and not any("0" <= c <= "9" for c in text):
            letters = text if text.isalpha() else "".join(c if c.isalpha() else " " for c in text)
            self.entry += [self._word(w) for w in letters.split(" ") if w]
        self.count.append(len(self.entry) - self.first[-1])
        return self.of.setdefault(chunk, len(self.first) - 1)

    def words_of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The words of the texts, by their places in the pool, and for each its text."""
        parts = [t.split() for t in texts]
        get = self.of.get
        ids = [get(c) for p in parts for c in p]
        if None in ids:
            chunks = [c for p in parts for c in p]
            for i, known in enumerate(ids):
                if known is None:
                    ids[i] = self.of[chunks[i]] if chunks[i] in self.of else self._add(chunks[i])
        ids = np.array(ids, np.int64)
        n = np.array(self.count, np.int64)[ids]
        at = np.repeat(np.array(self.first, np.int64)[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        text = np.repeat(np.repeat(np.arange(len(texts)), [len(p) for p in parts]), n)
        return np.array(self.entry, np.int64)[at], text

    def joints_of(self, words: np.ndarray, text: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The different n-grams of 3 that join two words, which of them each pair of neighbours has, and its text."""
        same = text[1:] == text[:-1]
        keys = np.array(self.tail, np.int64)[words[:-1][same]] << 32 | np.array(self.head, np.int64)[words[1:][same]]
        each, which = np.unique(keys, return_inverse=True)
        return [f"{chr(k >> 32)} {chr(k & 0xFFFFFFFF)}" for k in each.tolist()], which, text[1:][same]


def _stretches(batch: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """Where texts begin in a batch, and as many as are taken at once."""
    at, room = 0, 0
    for i, text in enumerate(batch):
        if i > at and room + len(text) > _STRETCH:
            yield at, batch[at:i]
            at, room = i, 0
        room += len(text)
    if batch:
        yield at, batch[at:]


def group_gram_counts(docs: DataFrame, key: str, text_col: str = "text", sizes: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """``gram_counts`` for a key of few values: a task counts the words of each, then the n-grams of the different words."""
    schema = StructType([docs.schema[key]]).add("gram", StringType()).add("n", LongType())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, sums, joints = WordPool(sizes), {}, {}

        def counted() -> Iterator[pa.RecordBatch]:
            grams, owner, names = np.array(pool.grams, np.int64), np.array(pool.owner, np.int64), list(pool.places)
            for value, n in sums.items():
                held = np.concatenate([n, np.zeros(len(pool.head) - len(n), np.int64)])
                total = np.bincount(grams, held[owner], len(names)).astype(np.int64)
                made = {names[k]: int(total[k]) for k in np.flatnonzero(total).tolist()}
                for gram, more in joints.get(value, {}).items():
                    made[gram] = made.get(gram, 0) + more
                if made:
                    yield pa.RecordBatch.from_arrays([pa.array([value] * len(made), kind), pa.array(made.keys(), pa.string()), pa.array(made.values(), pa.int64())], [key, "gram", "n"])
            sums.clear()
            joints.clear()
            pool.clear()
            pool.places.clear()

        for batch in batches:
            kind, values = batch.column(0).type, batch.column(0).to_pylist()
            for at, texts in _stretches(batch.column(1).to_pylist()):
                own: dict = {}
                for i, text in enumerate(texts):
                    own.setdefault(values[at + i], []).append(text)
                for value, some in own.items():
                    words, text = pool.words_of(some)
                    n = np.bincount(words, minlength=len(pool.head)).astype(np.int64)
                    if value in sums:
                        n[: len(sums[value])] += sums[value]
                    sums[value] = n
                    if 3 in sizes:
                        names, which, _ = pool.joints_of(words, text)
                        held = joints.setdefault(value, {})
                        for gram, more in zip(names, np.bincount(which, minlength=len(names)).tolist(), strict=True):
                            held[gram] = held.get(gram, 0) + more
                if pool.full():
                    yield from counted()
        if sums:
            yield from counted()

    lowered = docs.select(key, F.lower(F.coalesce(text_col, F.lit(""))).cast("binary").alias("_t"))
    return lowered.mapInArrow(count, schema).groupBy(key, "gram").agg(F.sum("n").alias("n"))


def fit_profiles(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", sizes: tuple[int, ...] = (1, 2, 3), min_count: int = 5) -> DataFrame:
    """``lang, gram, p``: share of each n-gram among the language's n-grams of its length."""
    known = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = group_gram_counts(known, "lang", sizes=sizes) if max(sizes) <= 3 else gram_counts(known, "lang", sizes=sizes)
    totals = counts.groupBy("lang", F.length("gram").alias("size")).agg(F.sum("n").alias("total"))
    return counts.where(F.col("n") >= min_count).withColumn("size", F.length("gram")).join(totals, ["lang", "size"]).select("lang", "gram", (F.col("n") / F.col("total")).alias("p"))


def _sums_by_language(grams: list[str], logs: np.ndarray, sizes: tuple[int, ...]):
    """A function of lower-cased text: for each language the sum of the logarithms of its known n-grams, and last how many
    they are."""
    known = {g: k for k, g in enumerate(grams)}
    rows = np.hstack([logs, np.ones((len(grams), 1))])
    width = rows.shape[1]

    @F.arrow_udf("array<double>")
    def sums(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pool = WordPool(sizes, known)
        scores, done, held = np.zeros((0, width)), 0, None
        for batch in batches:
            for _, texts in _stretches(batch.to_pylist()):
                if pool.full():
                    pool.clear()
                words, text = pool.words_of(texts)
                if held is not pool.words:
                    held, scores, done = pool.words, np.zeros((0, width)), 0
                if len(pool.head) > len(scores):  # the words that are new
                    fresh = len(pool.head) - len(scores)
                    owner, more = np.array(pool.owner[done:], np.int64) - len(scores), rows[np.array(pool.grams[done:], np.int64)]
                    scores = np.vstack([scores, np.stack([np.bincount(owner, more[:, c], fresh) for c in range(width)], 1)])
                    done = len(pool.owner)
                total = np.stack([np.bincount(text, scores[words, c], len(texts)) for c in range(width)], 1)
                if 3 in sizes and len(words):
                    names, which, of = pool.joints_of(words, text)
                    at = np.array([known.get(g, -1) for g in names], np.int64)
                    joint = np.where((at >= 0)[:, None], rows[at], 0.0) if len(names) else rows[:0]
                    total += np.stack([np.bincount(of, joint[which, c], len(texts)) for c in range(width)], 1)
                yield pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * width), pa.array(total.ravel()))

    return sums


def detect_all(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.5, threshold: float = 0.1, sizes: tuple[int, ...] = (1, 2, 3), max_languages: int = 1000) -> DataFrame:
    """``doc_id, lang, log_p, p`` of languages over the threshold: every known n-gram counts, none is sampled.

    Each language is a column, so more than ``max_languages`` are an error. Documents without a known n-gram have no row.
    Profiles of up to ``PROFILE_ROWS`` rows score each different word once a task; larger ones are joined with all n-grams.
    """
    floor = alpha / 10_000
    asked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = profiles.select("lang", "gram", "p").limit(PROFILE_ROWS + 1).toArrow() if max(sizes) <= 3 else None
    few = held is not None and held.num_rows <= PROFILE_ROWS
    names = sorted(set(held["lang"].to_pylist())) if few else [r.lang for r in profiles.select("lang").distinct().orderBy("lang").limit(max_languages + 1).collect()]
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    if few and names:
        encoded = held["gram"].combine_chunks().dictionary_encode()
        logs = np.full((len(encoded.dictionary), len(names)), np.log(floor))
        logs[encoded.indices.to_numpy(), [names.index(x) for x in held["lang"].to_pylist()]] = np.log(held["p"].to_numpy() + floor)
        each = asked.select("doc_id", _sums_by_language(encoded.dictionary.to_pylist(), logs, sizes)(F.lower(F.coalesce("text", F.lit(""))).cast("binary")).alias("_s"))
        summed = each.groupBy("doc_id").agg(*[F.sum(F.get("_s", F.lit(k))).alias(f"_{k}") for k in range(len(names) + 1)])
        scored = summed.where(F.col(f"_{len(names)}") > 0).drop(f"_{len(names)}")
    else:
        counts = gram_counts(asked, "doc_id", sizes=sizes)
        known = profiles.groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("lang", "p"))).alias("ps"))
        sums = [F.sum(F.col("n") * F.log(F.coalesce(F.try_element_at("ps", F.lit(x)), F.lit(0.0)) + floor)).alias(f"_{k}") for k, x in enumerate(names)]
        scored = counts.join(known, "gram").groupBy("doc_id").agg(*sums) if names else counts.groupBy("doc_id").agg(F.lit(0.0).alias("_0"))
    rows = F.array(*[F.named_struct(F.lit("lang"), F.lit(x), F.lit("log_p"), F.col(f"_{k}")) for k, x in enumerate(names)]) if names else F.array().cast("array<struct<lang:string,log_p:double>>")
    top = F.array_max(F.transform(rows, lambda r: r["log_p"]))
    each = scored.select("doc_id", top.alias("_top"), F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + F.exp(r["log_p"] - top)).alias("_sum"), F.inline_outer(rows)).where("lang is not null")
    return each.select("doc_id", "lang", "log_p", (F.exp(F.col("log_p") - F.col("_top")) / F.col("_sum")).alias("p")).where(F.col("p") > threshold)


def detect(docs: DataFrame, profiles: DataFrame, **options) -> DataFrame:
    """``doc_id, lang, p``: the likeliest language of every document; ``und`` where no n-gram is known."""
    best = detect_all(docs, profiles, **{**options, "threshold": -1.0}).groupBy("doc_id").agg(F.max(F.struct("p", "lang")).alias("_b"))
    every = docs.select(F.col(options.get("id_col", "doc_id")).alias("doc_id"))
    return every.join(best, "doc_id", "left").select("doc_id", F.coalesce("_b.lang", F.lit("und")).alias("lang"), F.coalesce("_b.p", F.lit(0.0)).alias("p"))


def murmur3(data: bytes, seed: int = 42) -> int:
    """The hash that Spark's HashingTF takes, as a signed number."""
    h, whole = seed, len(data) & ~3
    turn = lambda x, r: (x << r | x >> 32 - r) & 0xFFFFFFFF
    for i in range(0, whole, 4):
        k = int.from_bytes(data[i : i + 4], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        h = turn(h ^ turn(k, 15) * 0x1B873593 & 0xFFFFFFFF, 13) * 5 + 0xE6546B64 & 0xFFFFFFFF
    if data[whole:]:
        k = int.from_bytes(data[whole:], "little") * 0xCC9E2D51 & 0xFFFFFFFF
        h ^= turn(k, 15) * 0x1B873593 & 0xFFFFFFFF
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
    h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


class HashedPool(WordPool):
    """The words of every chunk met, with the buckets of their n-grams of 2 to 4; no word is left out."""

    def __init__(self, buckets: int):
        self.buckets, self.bucket_of = buckets, {}
        super().__init__((2, 3, 4), {})

    def full(self) -> bool:
        return len(self.of) > min(_REMEMBERED, 30_000)  # a word has some twenty n-grams

    def clear(self) -> None:
        super().clear()
        self.bucket_of.clear()
        self.heads, self.tails, self.ends = {}, {}, {}

    def place(self, gram: str) -> int:
        at = self.bucket_of.get(gram)
        if at is None:
            at = self.bucket_of[gram] = murmur3(gram.encode()) % self.buckets
        return at

    def _word(self, word: str) -> int:
        known = len(self.head)
        at = super()._word(word)
        if at == known:  # a new one: what joints need of it
            self.head[at] = self.heads.setdefault((word + " ")[:2], len(self.heads))
            self.tail[at] = self.tails.setdefault((" " + word)[-2:], len(self.tails))
        return at

    def _add(self, chunk: bytes) -> int:
        text = chunk.decode()
        self.first.append(len(self.entry))
        letters = text if text.isalpha() else "".join(c if c.isalpha() else " " for c in text)
        self.entry += [self._word(w) for w in letters.split(" ") if w]
        self.count.append(len(self.entry) - self.first[-1])
        return self.of.setdefault(chunk, len(self.first) - 1)

    def counts(self, texts: list[bytes]) -> np.ndarray:
        """Texts by buckets: how many n-grams of each text fall into each bucket."""
        words, text = self.words_of(texts)
        total = np.zeros(len(texts) * self.buckets)

        def add(of: np.ndarray, buckets: np.ndarray, n: np.ndarray) -> None:
            total[:] += np.bincount(of * self.buckets + buckets, n, len(total))

        grams, owner = np.array(self.grams, np.int64), np.array(self.owner, np.int64)
        size = np.bincount(owner, minlength=len(self.head))
        first = np.cumsum(size) - size
        pairs, n = np.unique(text * max(1, len(self.head)) + words, return_counts=True)
        of, word = np.divmod(pairs, max(1, len(self.head)))
        at = np.repeat(first[word] - (np.cumsum(size[word]) - size[word]), size[word]) + np.arange(int(size[word].sum()))
        add(np.repeat(of, size[word]), grams[at], np.repeat(n, size[word]).astype(float))
        same = text[1:] == text[:-1]
        keys = np.array(self.tail, np.int64)[words[:-1][same]] << 32 | np.array(self.head, np.int64)[words[1:][same]]
        each, which = np.unique(keys, return_inverse=True)
        tails, heads = list(self.tails), list(self.heads)
        joined = [(tails[k >> 32], heads[k & 0xFFFFFFFF]) for k in each.tolist()]
        for made in (lambda t, h: f"{t[1]} {h[0]}", lambda t, h: f"{t} {h[0]}", lambda t, h: f"{t[1]} {h}"):
            if joined:
                add(text[1:][same], np.array([self.place(made(t, h)) for t, h in joined], np.int64)[which], np.ones(len(which)))
        # with fewer than four characters a text is an n-gram itself for each longer size
        n_words = np.bincount(text, minlength=len(texts))
        for k in np.flatnonzero(n_words == 0).tolist():
            total[k * self.buckets + self.place("  ")] += 3
        one = np.flatnonzero(n_words[text] == 1)
        for k, w in zip(text[one].tolist(), words[one].tolist(), strict=True):
            if size[w] == 3:  # of a letter with its blanks: two n-grams of 2, one of 3
                total[k * self.buckets + grams[first[w] + 2]] += 1
        return total.reshape(len(texts), self.buckets)


def hashed_ngrams(text: Column, buckets: int) -> Column:
    """The vector that ``HashingTF`` has of a lower-cased text's n-grams of 2 to 4 characters, all but letters being blanks."""
    from pyspark.ml.linalg import VectorUDT

    @F.arrow_udf(VectorUDT())
    def made(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pool = HashedPool(buckets)
        some_rows = max(1, (1 << 21) // buckets)
        for batch in batches:
            values = batch.to_pylist()
            for at in range(0, len(values), some_rows):
                if pool.full():
                    pool.clear()
                total = pool.counts(values[at : at + some_rows])
                row, bucket = np.nonzero(total)
                cut = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(total)))]).astype(np.int32))
                indices, numbers = pa.ListArray.from_arrays(cut, pa.array(bucket.astype(np.int32))), pa.ListArray.from_arrays(cut, pa.array(total[row, bucket]))
                yield pa.StructArray.from_arrays([pa.array(np.zeros(len(total), np.int8)), pa.array(np.full(len(total), buckets, np.int32)), indices, numbers], ["type", "size", "indices", "values"])

    return made(F.lower(F.coalesce(text, F.lit(""))).cast("binary"))


class LinearDetector:
    """Labels of hashed character n-grams by a linear model; its predictions are in ``prediction_lang``."""

    def __init__(self, model, labels: list[str], text_col: str, buckets: int):
        self.model, self.labels, self.text_col, self.buckets = model, labels, text_col, buckets

    def transform(self, docs: DataFrame) -> DataFrame:
        from pyspark.ml.feature import IndexToString

        made = self.model.transform(docs.withColumn("_features", hashed_ngrams(F.col(self.text_col), self.buckets)))
        return IndexToString(inputCol="prediction", outputCol="prediction_lang", labels=self.labels).transform(made)


def fit_linear_detector(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", buckets: int = 1 << 14, iterations: int = 30) -> LinearDetector:
    """A model over hashed character 2- to 4-grams; its predictions are in ``prediction_lang``."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StringIndexer

    labels = StringIndexer(inputCol=lang_col, outputCol="_label", handleInvalid="skip", stringOrderType="alphabetAsc").fit(docs)
    held = labels.transform(docs).select("_label", hashed_ngrams(F.col(text_col), buckets).alias("_features"))
    model = LogisticRegression(featuresCol="_features", labelCol="_label", maxIter=iterations, regParam=1e-4).fit(held)
    return LinearDetector(model, labels.labels, text_col, buckets)


def gated(lang: Column, wanted: str | None, new: Column, old: Column) -> Column:
    """``new`` where the document's language is the stage's or either is unknown, else ``old``."""
    return new if wanted is None else F.when(lang.isNull() | (lang == wanted), new).otherwise(old)
