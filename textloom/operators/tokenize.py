"""Tokenizers. Between white space a token's bounds depend on its own chunk alone, so chunks are cut once and remembered."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.chars import URL_OR_EMAIL
from textloom.schema import PIECE

# fixed values: characters that tokens are cut at
SENTENCE = "…:;!?."
HYPHEN = "-–—~"
PUNCTUATION = "…,:;!?¿¡()[]{}<>_#*&"
QUOTES = "'\"”“`‘´’‚„»«「」『』（）〔〕【】《》〈〉"
CLOSING_QUOTES = "'\"”´’‚,„»」』）〕】》〉"
PREFIXES = "§%=+" + PUNCTUATION + QUOTES + "$¢£¤¥^|~¦¨©¬®¯°±´¸×÷€₹₽"

_CHUNK = re.compile(r"\S+")
_URL = re.compile(URL_OR_EMAIL)
#: A pictograph with its modifiers and tags, several joined by U+200D, a flag of two letters, or a key cap.
_PICTURE = "[\U0001f300-\U0001faff\u2600-\u27bf\u2b00-\u2bff\u231a-\u23ff][\ufe0f\U0001f3fb-\U0001f3ff]*[\U000e0020-\U000e007f]*"
_EMOJI = re.compile(f"(?:[\U0001f1e6-\U0001f1ff]{{2}}|[0-9#*]\ufe0f?\u20e3|{_PICTURE}(?:\u200d{_PICTURE})*)")
_WHOLE = re.compile(rf"(?:[{SENTENCE}]+|[{HYPHEN}]+|[$+<=>^`|~¢-©¬®-±´¸×÷€₹]+)\Z")
_INFIX = re.compile(r"(?<=\w)(?:\.{2,}|-{2,}|_{2,}|…+)(?=\w)|(?<=[^\W\d_A-Z])\.(?=[A-Z])|\.(?=[^\w.])|:(?!//)|[" + re.escape("…,;!?¿¡()[]{}<>#*&=|^$£€¥\"“”«»„") + "]")
#: Chunks that a worker remembers in all.
_MEMO_LIMIT = 100_000


def time_exceptions() -> dict[str, list[str] | None]:
    """Hours with am or pm, in three casings."""
    out = {}
    for hour in range(13):
        for half in ("am", "a.m", "a.m.", "am.", "pm", "p.m", "p.m.", "pm."):
            full = f"{half[0]}.m."
            out |= {f"{hour}{half}": [str(hour), full], f"{hour}{half.upper()}": [str(hour), full.upper()], f"{hour}{half.title()}": [str(hour), full]}
    return out


def emoticons() -> set[str]:
    """Faces kept whole: eyes, perhaps a nose or a tear, and a mouth, the other way round where that reads as a face too,
    and two equal eyes about a mouth."""
    out = {eyes + nose + mouth for eyes in ":;=" for nose in ("", "-", "'", "'-") for mouth in ")(][DPpOo/\\|*$"}
    out |= {mouth + nose + eyes for eyes in ":;=" for nose in ("", "-") for mouth in ")(]["}
    out |= {eye + mouth + eye for eye in "^oO-TxX" for mouth in "_."}
    return out | {"<3", "</3", "8-)", "XD", "xD", "\\o/"}


#: English verbs that lean on the word before them, and how they are then written.
CLITICS = {"am": "'m", "are": "'re", "is": "'s", "have": "'ve", "will": "'ll", "would": "'d"}
#: Which of them follow which words.
LEANING = {
    ("i",): ("am", "have", "will", "would"),
    ("you", "we", "they"): ("are", "have", "will", "would"),
    ("he", "she", "it", "that", "there", "here", "this", "who", "what", "where", "when", "why", "how"): ("is", "will", "would"),
}
#: Verbs that take a negation as they are, and those that change before it.
NEGATED = ("are", "could", "did", "do", "does", "had", "has", "have", "is", "might", "must", "need", "should", "was", "were", "would")
CHANGED = {"ca": "can", "wo": "will", "sha": "shall", "ai": "is"}
#: Written together in speech.
FUSED = {"cannot": "can not", "gonna": "going to", "gotta": "got to", "wanna": "want to", "lemme": "let me", "gimme": "give me", "let's": "let us", "y'all": "you all"}
#: Short forms whose full stop is their own, by language.
SHORT_FORMS = {
    "en": "Capt Col Dr Gen Gov Hon Lt Mr Mrs Ms Prof Rev Sen Sgt St Jr Sr Bros Co Corp Inc Ltd Jan Feb Mar Apr Jun Jul Aug Sept Oct Nov Dec e.g i.e cf viz vs approx dept est".split(),
    "de": "bzw ca Dr d.h evtl ggf Hr Fr Nr Prof S Str u.a usw vgl z.B".split(),
    "fr": "av bd cf Dr M MM Mlle Mme p.ex St Ste".split(),
    "es": "Av Dr Dra Lic Prof Sr Sra Srta Ud Uds p.ej".split(),
}


def english_contractions() -> dict[str, list[str]]:
    """Contractions and the words that they stand for, with either apostrophe and in three casings."""
    plain: dict[str, list[str]] = {short: full.split() for short, full in FUSED.items()}
    for heads, verbs in LEANING.items():
        for head in heads:
            plain |= {head + CLITICS[v]: [head, v] for v in verbs}
            plain[head + "'d've"] = [head, "would", "have"]
    for written, verb in ({v: v for v in NEGATED} | CHANGED).items():
        plain[written + "n't"] = [verb, "not"]
    for verb in ("could", "might", "must", "should", "would"):
        plain |= {verb + "'ve": [verb, "have"], verb + "n't've": [verb, "not", "have"]}
    # without an apostrophe only where that is no other word
    plain |= {w.replace("'", ""): parts for w, parts in plain.items() if parts[1:] == ["not"] and w not in ("can't", "won't", "cannot")}
    out = {}
    for word, parts in plain.items():
        for cased in (str.lower, str.upper, str.capitalize):
            own = [x.upper() for x in parts] if cased is str.upper and len(word) > 3 else [cased(parts[0]), *parts[1:]]
            out |= {cased(word): own, cased(word).replace("'", "’"): own}
    return out


def exceptions_for(lang: str | None) -> dict[str, list[str] | None]:
    """What is kept whole (None) or stands for other words in a language; null stands for English."""
    lang = lang or "en"
    short = {x + "." for x in SHORT_FORMS.get(lang, ())}
    own = dict.fromkeys(emoticons() | short | {x[0].upper() + x[1:] for x in short}) | time_exceptions()
    return own | english_contractions() if lang == "en" else own


#: What a final full stop belongs to: single letters between stops, an initial, and a short form without vowels.
_KEEPS_STOP = re.compile(r"(?:[^\W\d_]\.)+[^\W\d_]|[A-ZÀ-Þ]|[A-Z][b-df-hj-np-tv-xz]{1,2}")
#: Last characters that are tokens of their own: after a digit, and after anything.
_AFTER_DIGIT, _AFTER_ANY = frozenset("+-*/$¢£¤¥€₹"), frozenset(PUNCTUATION + CLOSING_QUOTES + "%°")


def _ends_with_own(s: str) -> bool:
    """Whether the last character is a token of its own."""
    if s[-1] == ".":
        return not _KEEPS_STOP.fullmatch(s[:-1])
    return s[-1] in _AFTER_ANY or s[-1] in _AFTER_DIGIT and s[-2].isdigit()


def _trails(s: str) -> bool:
    """Whether the last character of an address is the sentence's: a mark, a quote, or a bracket that the address doesn't open."""
    return s[-1] in SENTENCE + "," + QUOTES or s[-1] in ")]}>" and s.count("([{<"[")]}>".index(s[-1])]) < s.count(s[-1])


def cut_chunk(chunk: str, exceptions: dict[str, list[str] | None]) -> list[tuple[int, int, str]]:
    """Tokens of a run of non-blank characters: begin, end (exclusive) and kind (word, url, emoji, special)."""
    if chunk.isalnum():  # no address, no picture, no mark
        return [(0, len(chunk), "special" if chunk in exceptions else "word")]
    out, tail = [], []
    b, e = 0, len(chunk)
    while b < e:
        s = chunk[b:e]
        if s in exceptions:
            out.append((b, e, "special"))
            break
        if _URL.match(s) and not _trails(s):
            out.append((b, e, "url"))
            break
        if face := _EMOJI.match(s):
            out.append((b, b + face.end(), "emoji"))
            b += face.end()
            continue
        if len(s) == 1 or s.isalnum() or _WHOLE.match(s):
            out.append((b, e, "word"))
            break
        if s[0] in PREFIXES or s[0] in HYPHEN and not s[1].isdigit():
            out.append((b, b + 1, "word"))
            b += 1
            continue
        if _ends_with_own(s):
            tail.append((e - 1, e, "word"))
            e -= 1
            continue
        cut = _INFIX.search(s)
        if not cut:
            out.append((b, e, "word"))
            break
        if cut.start():
            out.append((b, b + cut.start(), "word"))
        out.append((b + cut.start(), b + cut.end(), "word"))
        b += cut.end()
    return out + tail[::-1]


class Tokenizer:
    def __init__(self, exceptions: dict[str, list[str] | None]):
        self.exceptions, self.memo = exceptions, {}

    def tokens_of(self, chunk: str) -> list[tuple[int, int, str, str]]:
        """Begin, end (exclusive), value and kind of each token. An exception's tokens take a character each, the last the rest."""
        got = []
        for b, e, kind in cut_chunk(chunk, self.exceptions):
            parts = self.exceptions.get(chunk[b:e]) if kind == "special" else None
            if not parts:
                got.append((b, e, chunk[b:e], kind))
            else:
                last = min(len(parts), e - b) - 1
                got += [(b + k, b + k + 1 if k < last else e, p, kind) for k, p in enumerate(parts[: last + 1])]
        return got

    def cut(self, text: str) -> list[tuple[int, int, str, str]]:
        """The tokens of a whole text."""
        out, memo = [], self.memo
        if len(memo) > _MEMO_LIMIT:
            memo.clear()
        for m in _CHUNK.finditer(text):
            chunk, at = m[0], m.start()
            got = memo.get(chunk)
            if got is None:
                got = self.tokens_of(chunk)
                if len(chunk) <= 100:
                    memo[chunk] = got
            for b, e, value, kind in got:
                out.append((at + b, at + e, value, kind))
        return out


#: Characters cut at once.
_STRETCH = 1 << 19
_BLANK = np.zeros(0x110000, bool)
_BLANK[[c for c in range(0x3001) if chr(c).isspace()]] = True


class ChunkPool:
    """The tokens of every chunk met, one after another, so that those of a text are gathered by their places."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenizer = tokenizer
        self.clear()

    def clear(self) -> None:
        self.of: dict[str, int] = {}
        self.first, self.count, self.begin, self.end, self.value, self.kind = [], [], [], [], [], []
        self.arrays = None

    def ids(self, chunks: list[str]) -> np.ndarray:
        if len(self.of) > _MEMO_LIMIT:
            self.clear()
        get = self.of.get
        out = [get(c) for c in chunks]
        if None in out:
            self.arrays = None
            for i, known in enumerate(out):
                if known is None:
                    chunk = chunks[i]
                    if chunk not in self.of:
                        self.of[chunk] = len(self.first)
                        tokens = self.tokenizer.tokens_of(chunk)
                        self.first.append(len(self.begin))
                        self.count.append(len(tokens))
                        for b, e, v, k in tokens:
                            self.begin.append(b)
                            self.end.append(e)
                            self.value.append(v)
                            self.kind.append(k)
                    out[i] = self.of[chunk]
        return np.array(out, np.int64)

    def gathered(self):
        if self.arrays is None:
            self.arrays = *(np.array(x, np.int64) for x in (self.first, self.count, self.begin, self.end)), pa.array(self.value, pa.string()), pa.array(self.kind, pa.string())
        return self.arrays


def _stretches(texts: list[str | None]) -> Iterator[list[str]]:
    some, room = [], 0
    for text in texts:
        text = text or ""
        if some and room + len(text) > _STRETCH:
            yield some
            some, room = [], 0
        some.append(text)
        room += len(text) + 1
    if some:
        yield some


def _tokens_of_texts(texts: list[str], pool: ChunkPool) -> pa.ListArray:
    joined = "\n".join(texts) + "\n"
    blank = _BLANK[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    edges = np.diff(blank.view(np.int8), prepend=1)
    starts = np.flatnonzero(edges == -1)
    ids = pool.ids(joined.split())
    first, count, begin, end, value, kind = pool.gathered()
    text_starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    of = np.searchsorted(text_starts, starts, side="right") - 1
    n = count[ids]
    per_text = np.bincount(of, n, len(texts)).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(per_text)])
    before = np.cumsum(n) - n
    at = np.repeat(first[ids] - before, n) + np.arange(int(n.sum()))
    moved = np.repeat(starts - text_starts[of], n)
    ix = np.arange(len(at)) - np.repeat(offsets[:-1], per_text)
    places = pa.array(at)
    fields = [ix.astype(np.int32), (begin[at] + moved).astype(np.int32), (end[at] + moved - 1).astype(np.int32)]
    tokens = pa.StructArray.from_arrays([*map(pa.array, fields), value.take(places), kind.take(places)], ["ix", "begin", "end", "value", "kind"])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), tokens)


def fast_tokens(text: Column, lang: str | None = "en", more_exceptions: dict[str, list[str] | None] | None = None) -> Column:
    """``array<struct<ix, begin, end, value, kind>>``, ends inclusive. Null gives an empty array."""
    exceptions = exceptions_for(lang) | (more_exceptions or {})

    @F.arrow_udf(f"array<{PIECE}>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        pool = ChunkPool(Tokenizer(exceptions))
        for texts in batches:
            for some in _stretches(texts.to_pylist()):  # each goes back by itself, so that a worker holds the tokens of one
                yield _tokens_of_texts(some, pool)

    return cut(text)


def _tokens_by_language(batches: Iterator[tuple[pa.Array, pa.Array]], by_lang: dict[str, dict]) -> Iterator[pa.ListArray]:
    """The tokens of texts with their languages, one stretch after another, so that a worker holds the tokens of one; the
    chunks remembered are those of all languages together."""
    langs = list(by_lang)
    pools = {x: ChunkPool(Tokenizer(exceptions)) for x, exceptions in by_lang.items()}
    for all_texts, all_langs in batches:
        done = 0
        for some in _stretches(all_texts.to_pylist()):
            of = [langs[0] if x is None else x for x in all_langs.slice(done, len(some)).to_pylist()]
            null = all_texts.slice(done, len(some)).is_null().to_pylist()
            done += len(some)
            if sum(len(pool.of) for pool in pools.values()) > _MEMO_LIMIT:
                for pool in pools.values():
                    pool.clear()
            order, made = [], []
            for x, pool in pools.items():
                own = [i for i, y in enumerate(of) if y == x and not null[i]]
                order += own
                if own:
                    made.append(_tokens_of_texts([some[i] for i in own], pool))
            at = np.full(len(some), -1, np.int64)
            at[order] = np.arange(len(order))
            all_ = pa.concat_arrays(made) if made else _tokens_of_texts([], pools[langs[0]])
            yield all_.take(pa.array(at, mask=at < 0))


def fast_tokens_by_language(text: Column, lang: Column, langs: list[str], more_exceptions: dict[str, list[str] | None] | None = None) -> Column:
    """``fast_tokens`` by the exceptions of each text's language, in one pass; null text, and one in a language that is
    not among ``langs``, gives null. A null language takes the first of ``langs``."""
    by_lang = {x: exceptions_for(x) | (more_exceptions or {}) for x in langs}

    @F.arrow_udf(f"array<{PIECE}>")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        return _tokens_by_language(batches, by_lang)

    return cut(text, lang)


def _spaced_texts(texts: list[str]) -> pa.ListArray:
    joined = " ".join(texts) + " "
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    edges = np.diff((chars == 32).view(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    values = [v for v in joined.split(" ") if v]
    if len(starts):
        kept = np.add.reduceat((~_BLANK[chars]).astype(np.int64), starts) > 0
        starts, ends, values = starts[kept], ends[kept], [v for v, k in zip(values, kept.tolist(), strict=True) if k]
    text_starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    of = np.searchsorted(text_starts, starts, side="right") - 1
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(texts)))]).astype(np.int32)
    ix = np.arange(len(starts)) - offsets[of]
    fields = [pa.array(x.astype(np.int32)) for x in (ix, starts - text_starts[of], ends - 1 - text_starts[of])]
    tokens = pa.StructArray.from_arrays([*fields, pa.array(values, pa.string()), pa.array(["word"] * len(values), pa.string())], ["ix", "begin", "end", "value", "kind"])
    return pa.ListArray.from_arrays(pa.array(offsets), tokens)


def space_tokens(text: Column) -> Column:
    """Pieces between U+0020, those of white space alone left out, with their offsets. Null gives an empty array."""

    @F.arrow_udf(f"array<{PIECE}>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            made = [_spaced_texts(some) for some in _stretches(texts.to_pylist())]
            yield pa.concat_arrays(made) if made else _spaced_texts([])

    return cut(text)


def exploded(df: DataFrame, tokens_col: str = "tokens", *kept: str) -> DataFrame:
    """A row for each token."""
    return df.select(*kept, F.inline_outer(tokens_col)).where("value is not null")


def tokenized_value(tokens: Column) -> Column:
    """The tokens' values joined by a blank."""
    return F.array_join(F.transform(tokens, lambda t: t["value"]), " ")


def with_neighbours(tokens: Column, text: Column) -> Column:
    """Tokens with the characters before and after them in the text, null at its ends."""
    # of the characters as an array: a substring would count from the text's start each time
    near = lambda c: F.transform(tokens, lambda t: F.struct(t["ix"].alias("ix"), t["value"].alias("value"), F.get(c, t["begin"] - 1).alias("previous_char"), F.get(c, t["end"] + 1).alias("next_char")))
    return F.get(F.transform(F.array(F.split(text, "")), near), F.lit(0))


def remove_overlapping(tokens: DataFrame, *keys: str) -> DataFrame:
    """Of the exploded tokens of one document that begin at one place, the longest."""
    from pyspark.sql import Window

    ranked = tokens.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "begin").orderBy(F.desc("end"), "ix")))
    return ranked.where("_rank = 1").drop("_rank")


def trim_tokens(tokens: Column) -> Column:
    """Bounds moved in over white space."""
    left = lambda v: F.length(v) - F.length(F.ltrim(v))
    right = lambda v: F.length(v) - F.length(F.rtrim(v))
    return F.transform(tokens, lambda t: t.withField("begin", t["begin"] + left(t["value"])).withField("end", t["end"] - right(t["value"])).withField("value", F.trim(t["value"])))


def replace_spans(text: Column, spans: Column, value) -> Column:
    """The text with each span (struct of ``start`` and inclusive ``end``) replaced by ``value(span)``, from the right; null keeps it."""
    ordered = F.reverse(F.array_sort(spans))
    slice_ = lambda acc, s: F.substring(acc, s["start"] + 1, s["end"] - s["start"] + 1)
    return F.aggregate(ordered, text, lambda acc, s: F.concat(F.substring(acc, F.lit(1), s["start"]), F.coalesce(value(s), slice_(acc, s)), F.substring(acc, s["end"] + 2, F.length(acc))))
