"""A pattern language over tokens: units with modes and tests, matched greedily without backtracking.

``Unit().is_numeric().length(4, 4)`` tests one token; ``many()``, ``optional()``, ``never()`` set how often it may match;
``either`` and ``both`` combine two units. A pattern is a list of alternatives, each a sequence of units; a spotter takes
the longest match at each token and goes on after it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from dataclasses import dataclass, field, replace
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions.chars import EMAIL, HYPHENS, URL_OR_EMAIL
from textloom.operators.tokenize import _BLANK, ChunkPool, Tokenizer, _stretches, exceptions_for
from textloom.schema import FINDING

_EMAIL, _URL = re.compile(EMAIL), re.compile(URL_OR_EMAIL)
_IPV4 = re.compile(r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\Z")


def shape_of(value: str) -> str:
    """The twin of ``textloom.functions.chars.shape`` for one string."""
    import unicodedata

    out = []
    for c in value:
        kind = unicodedata.category(c)
        out.append(c if c in "@~" else "/" if c in "/\\" else "-" if c in HYPHENS else "x" if kind == "Ll" else "X" if kind == "Lu" else "9" if kind[0] == "N" else "." if kind[0] == "P" else "#")
    return "".join(out)


def _like_shape(shape: str, wanted: str) -> bool:
    return len(shape) == len(wanted) and all(w == s or w == "~" and s in "xX9" for s, w in zip(shape, wanted, strict=True))


def _capital(v: str) -> bool:
    return bool(v) and v[0].isupper() and any(c.islower() for c in v)


@dataclass(frozen=True)
class Unit:
    tests: tuple = ()
    mode: str = "single"  # single, many
    may_miss: bool = False
    most: int = 1
    negated: bool = False

    def _with(self, *test) -> Unit:
        return replace(self, tests=(*self.tests, test))

    def many(self, most: int = 10) -> Unit:
        return replace(self, mode="many", most=most or 10)

    def optional(self) -> Unit:
        return replace(self, may_miss=True)

    def never(self) -> Unit:
        """Tokens that don't pass, as many as there are up to ten."""
        return replace(self, negated=True, mode="many", most=10)

    def token(self, *values: str, ignore_case: bool = False) -> Unit:
        return self._with("token", frozenset(v.lower() for v in values) if ignore_case else frozenset(values), ignore_case)

    def chars(self, allowed: str) -> Unit:
        return self._with("chars", frozenset(allowed))

    def pos(self, *tags: str) -> Unit:
        return self._with("pos", frozenset(tags))

    def prefix(self, listed: str) -> Unit:
        return self._with("prefix", tuple(x for x in re.split(r"[,\s]+", listed) if x))

    def suffix(self, listed: str) -> Unit:
        return self._with("suffix", tuple(x for x in re.split(r"[,\s]+", listed) if x))

    def entity(self, *types: str) -> Unit:
        return self._with("entity", frozenset(types))

    def no_entity(self, *types: str) -> Unit:
        return self._with("no_entity", frozenset(types))

    def shape(self, *shapes: str) -> Unit:
        return self._with("shape", shapes)

    def length(self, least: int = 0, most: int = 0) -> Unit:
        return self._with("length", least, most)

    def is_numeric(self) -> Unit:
        return self._with("numeric")

    def is_digit(self) -> Unit:
        return self._with("digit")

    def has_numeric(self) -> Unit:
        return self._with("has_numeric")

    def is_alpha(self) -> Unit:
        return self._with("alpha")

    def is_letter_or_digit(self) -> Unit:
        return self._with("alnum")

    def is_latin(self) -> Unit:
        return self._with("latin")

    def is_emoji(self) -> Unit:
        return self._with("emoji")

    def is_punctuation(self) -> Unit:
        return self._with("punctuation")

    def is_lower(self) -> Unit:
        return self._with("lower")

    def is_upper(self) -> Unit:
        return self._with("upper")

    def is_title(self) -> Unit:
        return self._with("title")

    def like_number(self) -> Unit:
        return self._with("like_number")

    def like_url(self) -> Unit:
        return self._with("url")

    def like_email(self) -> Unit:
        return self._with("email")

    def like_ip(self) -> Unit:
        return self._with("ip")

    def opens(self) -> Unit:
        return self.token("(", "[")

    def closes(self) -> Unit:
        return self.token(")", "]")

    def passes(self, value: str, pos: str | None = None, entities: tuple[str, ...] = ()) -> bool:
        return all(_TESTS[t[0]](value, pos, entities, *t[1:]) for t in self.tests)


def both(a: Unit, b: Unit) -> Unit:
    return Unit((("both", a, b),)).many()


def either(a: Unit, b: Unit) -> Unit:
    return Unit((("either", a, b),)).many()


_EMOJI = re.compile("[\U0001f300-\U0001faff☀-➿⬀-⯿\U0001f1e6-\U0001f1ff‍️]+\\Z")
_PUNCTUATION = re.compile(r"[!-#%-*,-/:;?@\[-\]_{}¡§«¶·»¿‐-‧‰-⁞、。「」『』（）〔〕【】《》〈〉]+\Z")
_TESTS = {
    "token": lambda v, p, e, values, fold: (v.lower() if fold else v) in values,
    "chars": lambda v, p, e, allowed: bool(v) and set(v) <= allowed,
    "pos": lambda v, p, e, tags: p in tags,
    "prefix": lambda v, p, e, any_: v.startswith(any_),
    "suffix": lambda v, p, e, any_: v.endswith(any_),
    "entity": lambda v, p, e, types: any(t in types for t in e),
    "no_entity": lambda v, p, e, types: not any(t in types for t in e),
    "shape": lambda v, p, e, shapes: any(len(v) == len(w) for w in shapes) and any(_like_shape(s, w) for s in (shape_of(v),) for w in shapes),
    "length": lambda v, p, e, least, most: len(v) >= least and (not most or len(v) <= most),
    "numeric": lambda v, p, e: v.isascii() and v.isdigit(),
    "digit": lambda v, p, e: v.isdecimal(),
    "has_numeric": lambda v, p, e: any("0" <= c <= "9" for c in v),
    "alpha": lambda v, p, e: v.isalpha(),
    "alnum": lambda v, p, e: bool(v) and all(c.isalpha() or c.isdecimal() for c in v),
    "latin": lambda v, p, e: v.isalpha() and all(c < "ɐ" for c in v),
    "emoji": lambda v, p, e: bool(_EMOJI.match(v)),
    "punctuation": lambda v, p, e: bool(_PUNCTUATION.match(v)),
    "lower": lambda v, p, e: bool(v) and not any(c.isupper() for c in v),
    "upper": lambda v, p, e: bool(v) and not any(c.islower() for c in v),
    "title": lambda v, p, e: _capital(v),
    "like_number": lambda v, p, e: bool(re.match(r"[-+]?\d+(?:[.,]\d+)*\Z", v)),
    "url": lambda v, p, e: bool(_URL.match(v)) and not _EMAIL.match(v),
    "email": lambda v, p, e: bool(_EMAIL.match(v)),
    "ip": lambda v, p, e: bool(_IPV4.match(v)),
    "both": lambda v, p, e, a, b: a.passes(v, p, e) and b.passes(v, p, e),
    "either": lambda v, p, e, a, b: a.passes(v, p, e) or b.passes(v, p, e),
}
_NEEDS_CONTEXT = {"pos", "entity", "no_entity"}


@dataclass
class Pattern:
    """Named alternatives; ``add`` puts in one more sequence of units."""

    name: str
    alternatives: list[tuple[Unit, ...]] = field(default_factory=list)

    def add(self, *units: Unit) -> Pattern:
        self.alternatives.append(units)
        return self


class Matcher:
    """Patterns over the tokens of one document after another. What a value passes is remembered."""

    def __init__(self, patterns: list[Pattern]):
        self.patterns, self.memo = patterns, {}

    def _passes(self, unit: Unit, token) -> bool:
        if any(t[0] in _NEEDS_CONTEXT or t[0] in ("both", "either") for t in unit.tests):
            return unit.passes(token[0], *token[1:]) != unit.negated
        key = unit, token[0]
        got = self.memo.get(key)
        if got is None:
            if len(self.memo) > 500_000:
                self.memo.clear()
            got = self.memo[key] = unit.passes(token[0]) != unit.negated
        return got

    def _run(self, units: tuple[Unit, ...], tokens: list, at: int) -> int:
        here = at
        for unit in units:
            n, most = 0, unit.most if unit.mode == "many" else 1
            while n < most and here < len(tokens) and self._passes(unit, tokens[here]):
                n, here = n + 1, here + 1
            if not n and not unit.may_miss:
                return 0
        return here - at

    def longest(self, tokens: list, at: int) -> int:
        return max((self._run(units, tokens, at) for p in self.patterns for units in p.alternatives), default=0)

    def spot(self, tokens: list) -> list[tuple[int, int]]:
        """First and last token of each match, leftmost and longest, without overlap. tokens: (value, pos, entity types)."""
        out, at = [], 0
        while at < len(tokens):
            n = self.longest(tokens, at)
            if n:
                out.append((at, at + n - 1))
            at += max(1, n)
        return out


@dataclass
class Recognizer:
    """What its patterns match is of one entity type."""

    entity_type: str
    patterns: list[Pattern]
    guard: str | None = None  # a text without this can't match


#: What a token passes at most in a shape's place.
_PLACES = {"9": r"[^\W_A-Za-z]", "X": r"[^\W\d_a-z]", "x": r"[^\W\d_A-Z]", "~": r"[^\W_]"}


def _necessary(unit: Unit) -> str:
    """A regular expression that every token of the unit matches from its start; it may match others."""
    if unit.negated:
        return ""
    out = []
    for kind, *with_ in unit.tests:
        if kind == "token" and not with_[1]:
            out.append("(?:" + "|".join(map(re.escape, sorted(with_[0]))) + ")\\Z")
        elif kind == "prefix":
            out.append("(?:" + "|".join(map(re.escape, with_[0])) + ")")
        elif kind == "shape":
            out.append("(?:" + "|".join("".join(_PLACES.get(c, ".") for c in w) for w in with_[0]) + ")\\Z")
        elif kind == "length":
            out.append(f".{{{with_[0]},{with_[1] or ''}}}\\Z")
        elif kind in ("numeric", "email", "ip"):
            out.append({"numeric": "[0-9]+\\Z", "email": "[^@]*@", "ip": "[0-9]+[.]"}[kind])
        elif kind == "url":
            out.append("[^:.]*[:.]")
        elif kind == "alnum":
            out.append(r"[^\W_]+\Z")
    # what rejects most stands first, the last one consumes
    return "".join(f"(?={x})" for x in sorted(out, key=lambda x: x.startswith(".")))


class Spotter:
    """The matches of recognizers in many texts at once. Only at a token that passes one of the first units of some
    alternative can a match begin, and whether a token does is found out once a distinct chunk; the matcher runs there alone."""

    def __init__(self, recognizers: list[Recognizer], tokenizer: Tokenizer):
        self.recognizers, self.pool = recognizers, ChunkPool(tokenizer)
        self.guards = [re.compile(r.guard) if r.guard else None for r in recognizers]
        self.matchers = [Matcher(r.patterns) for r in recognizers]
        self.heads: dict[Unit, set[int]] = defaultdict(set)
        self.reach = 1
        for k, units in ((k, a) for k, r in enumerate(recognizers) for p in r.patterns for a in p.alternatives):
            self.reach = max(self.reach, sum(u.most if u.mode == "many" else 1 for u in units))
            for u in units:
                self.heads[u].add(k)
                if not u.may_miss:
                    break
        self.may = re.compile("|".join(dict.fromkeys(map(_necessary, self.heads))), re.DOTALL)
        self.known, self.begins, self.of, self.lookup, self.memo = 0, [], None, {}, {}

    def _starts(self, value: str) -> tuple[int, ...]:
        """The recognizers of which a match can begin with this token."""
        if not self.heads or not self.may.match(value):
            return ()
        got = self.memo.get(value)
        if got is None:
            got = self.memo[value] = tuple(sorted({k for unit, ks in self.heads.items() if unit.passes(value) != unit.negated for k in ks}))
        return got

    def _look_at_new(self) -> np.ndarray:
        """For each chunk of the pool whether a match can begin in it."""
        pool = self.pool
        if pool.of is not self.of:  # the pool was cleared
            self.known, self.begins, self.of, self.lookup, self.memo = 0, [], pool.of, {}, {}
        for chunk in range(self.known, len(pool.first)):
            at = pool.first[chunk]
            found = [(j, ks) for j in range(pool.count[chunk]) if (ks := self._starts(pool.value[at + j]))]
            self.begins.append(bool(found))
            if found:
                self.lookup[chunk] = found
        self.known = len(pool.first)
        return np.array(self.begins, bool)

    def findings(self, texts: list[str]) -> pa.ListArray:
        pool = self.pool
        joined = "\n".join(texts) + "\n"
        ids = pool.ids(joined.split())
        where = np.flatnonzero(self._look_at_new()[ids]) if len(ids) else ids
        found: list[set] = [set() for _ in texts]
        if len(where):
            blank = _BLANK[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
            starts = np.flatnonzero(np.diff(blank.view(np.int8), prepend=1) == -1)
            text_starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
            ends = np.searchsorted(starts, text_starts[1:])  # the chunk after each text's last
            n = np.array(pool.count, np.int64)[ids]
            before = np.cumsum(n) - n
            of = np.searchsorted(text_starts, starts[where], side="right") - 1
            self._spot(texts, where.tolist(), of.tolist(), ends[of].tolist(), before[where].tolist(), ids, starts, text_starts, found)
        each = [sorted(x) for x in found]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
        flat = [x for some in each for x in some]
        kinds = pa.int32(), pa.int32(), pa.string(), pa.float32()
        columns = [*zip(*flat)] if flat else [(), (), ()]
        fields = [pa.array(x, kind) for x, kind in zip([*columns, np.ones(len(flat), np.float32)], kinds, strict=True)]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "end", "entity_type", "score"]))

    def _spot(self, texts, where, of, ends, before, ids, starts, text_starts, found) -> None:
        pool, free = self.pool, [0] * len(self.recognizers)
        for at, text, end, ordinal in zip(where, of, ends, before, strict=True):
            # the tokens from this chunk on, as far as a match that begins in it can reach, with their places
            chunk, window, places = int(ids[at]), [], []
            need = pool.count[chunk] + self.reach
            for c in range(at, end):
                first = pool.first[k := int(ids[c])]
                for e in range(first, first + pool.count[k]):
                    window.append((pool.value[e], None, ()))
                    places.append((c, e))
                if len(window) >= need:
                    break
            for j, ks in self.lookup[chunk]:
                for r in ks:
                    if ordinal + j < free[r] or not (n := self.matchers[r].longest(window, j)):
                        continue
                    free[r] = ordinal + j + n
                    if self.guards[r] and not self.guards[r].search(texts[text]):
                        continue
                    (a, b), (c, d) = places[j], places[j + n - 1]
                    moved = text_starts[text]
                    found[text].add((int(starts[a] - moved) + pool.begin[b], int(starts[c] - moved) + pool.end[d] - 1, self.recognizers[r].entity_type))


def find_entities(text: Column, recognizers: list[Recognizer], lang: str | None = "en") -> Column:
    """``array<struct<start, end, entity_type, score>>`` by start, end and type; each (start, end, type) once, score 1."""
    exceptions = exceptions_for(lang)

    @F.arrow_udf(f"array<{FINDING}>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        spotter = Spotter(recognizers, Tokenizer(exceptions))
        for texts in batches:
            for some in _stretches(texts.to_pylist()):
                yield spotter.findings(some)

    return find(text)


def find_in_tokens(tokens: Column, recognizers: list[Recognizer], tags: Column | None = None, found: Column | None = None) -> Column:
    """As ``find_entities``, over tokens that are there already, with the part of speech of each (``tags``) and the types
    of the entities (``found``: start, end, entity_type) in which it lies; null tokens give null."""

    @F.pandas_udf(f"array<{FINDING}>")
    def find(values: pd.Series, begins: pd.Series, ends: pd.Series, tags: pd.Series, found: pd.Series) -> pd.Series:
        matchers = [(r.entity_type, Matcher(r.patterns)) for r in recognizers]
        out = []
        for value, begin, end, tag, known in zip(values, begins, ends, tags, found, strict=True):
            if value is None:
                out.append(None)
                continue
            types: list[tuple[str, ...]] = [()] * len(value)
            for f in known if known is not None else ():
                first, after = bisect_left(list(begin), f["start"]), bisect_right(list(begin), f["end"])
                for k in range(first, after):
                    types[k] = (*types[k], f["entity_type"])
            each = list(zip(value, tag if tag is not None else [None] * len(value), types, strict=True))
            got = {(int(begin[a]), int(end[b]), kind) for kind, m in matchers for a, b in m.spot(each)}
            out.append([{"start": a, "end": b, "entity_type": kind, "score": 1.0} for a, b, kind in sorted(got)])
        return pd.Series(out)

    part = lambda name: F.transform(tokens, lambda t: t[name])
    kept = F.transform(found, lambda f: F.struct(f["start"].alias("start"), f["end"].alias("end"), f["entity_type"].alias("entity_type"))) if found is not None else F.lit(None).cast("array<struct<start:int,end:int,entity_type:string>>")
    return find(part("value"), part("begin"), part("end"), tags if tags is not None else F.lit(None).cast("array<string>"), kept)


def literal_tokens(patterns: list[Pattern]) -> set[str] | None:
    """Tokens, in lower case, of which a text must have one if any of the patterns is to match: of each alternative the
    smallest set that it can't do without. None if some alternative needs no token in particular."""
    out: set[str] = set()
    for units in (a for p in patterns for a in p.alternatives):
        needed = [{v.lower() for v in test[1]} for u in units if not u.may_miss and not u.negated for test in u.tests if test[0] == "token"]
        if not needed:
            return None
        out |= min(needed, key=len)
    return out


def entities_of_tags(tokens: Column, tags: Column) -> Column:
    """The entities that B/I/L/O/U tags of the tokens spell, as ``array<struct<start, end, entity_type, score>>``."""
    none = F.array().cast(f"array<{FINDING}>")
    state = lambda start, out: F.struct(start.alias("start"), out.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        kind, letter = F.substring(x["tag"], F.lit(3), F.length(x["tag"])), F.substring(x["tag"], 1, 1)
        start = F.when(letter.isin("B", "U"), x["begin"]).otherwise(acc["start"])
        made = F.struct(start.cast("int").alias("start"), x["end"].cast("int").alias("end"), kind.alias("entity_type"), F.lit(1.0).cast("float").alias("score"))
        return state(start, F.when(letter.isin("L", "U"), F.array_append(acc["out"], made.cast(FINDING))).otherwise(acc["out"]))

    each = F.zip_with(tokens, tags, lambda t, g: F.struct(t["begin"].alias("begin"), t["end"].alias("end"), g.alias("tag")))
    return F.when(tokens.isNotNull() & tags.isNotNull(), F.aggregate(each, state(F.lit(0), none), step, lambda acc: acc["out"]))


def has_any_entity(text: Column, recognizers: list[Recognizer], lang: str | None = "en") -> Column:
    return F.size(find_entities(text, recognizers, lang)) > 0


def optimise(pattern: Pattern) -> Pattern:
    """Alternatives of one length that are all plain tokens become one, with a set of tokens at each place, if that
    accepts nothing more: that is, if they differ at one place at most."""
    plain = [a for a in pattern.alternatives if all(len(u.tests) == 1 and u.tests[0][0] == "token" and u.mode == "single" and not u.may_miss and not u.negated for u in a)]
    rest = [a for a in pattern.alternatives if a not in plain]
    groups: list[tuple[Unit, ...]] = []
    for a in plain:
        for k, g in enumerate(groups):
            apart = [i for i in range(len(a)) if len(g) == len(a) and a[i] != g[i]]
            if len(g) == len(a) and len(apart) <= 1 and all(a[i].tests[0][2] == g[i].tests[0][2] for i in apart):
                groups[k] = tuple(Unit((("token", x.tests[0][1] | y.tests[0][1], x.tests[0][2]),)) for x, y in zip(g, a, strict=True))
                break
        else:
            groups.append(a)
    return Pattern(pattern.name, rest + groups)
