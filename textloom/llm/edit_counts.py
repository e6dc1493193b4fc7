"""Token counts that follow edits: a segment tree over each document's pre-tokens.

A leaf holds a stretch of pre-tokens with its characters and tokens, an inner node the sums below it. Trees are kept as
a table: a text beside its sums, from which a later batch of edits goes on. An edit re-encodes the leaves that it
touches, those just before whose ends its text may move, and those after it up to the first leaf that begins where a new
pre-token does; sums change only on the paths from these leaves to the root.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.shared import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE vocabularies of this kind cut texts (fixed value, part of the vocabulary).
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens of a leaf when it is made.
STRETCH = 32
#: A pre-token's end depends on no character further on than this after the next one that isn't white space.
LOOK_AHEAD = 4
_MEMO_LIMIT = 400_000


class PieceCounter:
    """Cuts a text into pre-tokens and counts the tokens of each."""

    def __init__(self, vocabulary: bytes, pattern: str = PRE_TOKENS):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.cut = regex.compile(pattern).findall
        self.memo: dict[str, int] = {}

    def count(self, piece: str) -> int:
        n = self.memo.get(piece)
        if n is None:
            if len(self.memo) >= _MEMO_LIMIT:
                self.memo.clear()
            n = len(self.encoding.encode_ordinary(piece))
            if len(piece) <= 64:
                self.memo[piece] = n
        return n

    def counts(self, pieces: list[str]) -> list[int]:
        get, count = self.memo.get, self.count
        return [get(p) or count(p) for p in pieces]


def _sums(leaves) -> list[int]:
    """A tree of sums: the root at 1, the children of k at 2k and 2k + 1, the leaves last; their number is a power of 2."""
    size = 1 << max(0, len(leaves) - 1).bit_length()
    nodes = np.zeros(2 * size, np.int64)
    nodes[size : size + len(leaves)] = leaves
    k = size
    while k > 1:
        nodes[k // 2 : k] = nodes[k : 2 * k].reshape(-1, 2).sum(1)
        k //= 2
    return nodes.tolist()


class CountTree:
    """Stretches of one text's pre-tokens with their characters and tokens, under edits."""

    def __init__(self, text: str, chars: list[int], tokens: list[int], counter: PieceCounter):
        self.counter, self.chars, self.tokens, self.reencoded = counter, chars, tokens, 0
        self.size = len(chars) // 2
        ends = np.cumsum(chars[self.size :]).tolist()
        n = bisect_left(ends, len(text)) + 1
        self.leaves = [text[a:b] for a, b in zip([0, *ends[: n - 1]], ends[:n], strict=True)]

    @staticmethod
    def sums_of(text: str, counter: PieceCounter) -> tuple[int, list[int], list[int]]:
        """The number of pre-tokens of a text, and the trees of its characters and tokens."""
        pieces = counter.cut(text)
        at = np.arange(0, len(pieces), STRETCH)
        if not len(at):
            return 0, [0, 0], [0, 0]
        chars = np.add.reduceat(np.fromiter(map(len, pieces), np.int64, len(pieces)), at)
        return len(pieces), _sums(chars), _sums(np.add.reduceat(np.array(counter.counts(pieces), np.int64), at))

    @staticmethod
    def of(text: str, counter: PieceCounter) -> CountTree:
        return CountTree(text, *CountTree.sums_of(text, counter)[1:], counter)

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf with the character at this offset, and where the leaf starts; the last leaf for the text's end."""
        if at >= self.chars[1]:
            return len(self.leaves) - 1, self.chars[1] - len(self.leaves[-1])
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if at - start >= self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.size, start

    def _set(self, leaf: int, text: str, n_tokens: int) -> None:
        self.leaves[leaf] = text
        node = leaf + self.size
        more_chars, more_tokens = len(text) - self.chars[node], n_tokens - self.tokens[node]
        while node and (more_chars or more_tokens):
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def _put(self, first: int, stop: int, pieces: list[str]) -> None:
        """Put new pre-tokens in the place of the leaves from ``first`` up to ``stop``."""
        counts = self.counter.counts(pieces)
        self.reencoded += len(pieces)
        at = range(0, len(pieces), STRETCH if len(pieces) > 2 * STRETCH else 2 * STRETCH)
        step = at.step
        new = [("".join(pieces[k : k + step]), sum(counts[k : k + step])) for k in at]
        if len(new) <= stop - first:
            for k in range(first, stop):
                self._set(k, *(new[k - first] if k - first < len(new) else ("", 0)))
            return
        own = self.tokens[self.size : self.size + len(self.leaves)]
        self.leaves[first:stop] = [t for t, _ in new]
        own[first:stop] = [n for _, n in new]
        self.chars, self.tokens = _sums([len(t) for t in self.leaves]), _sums(own)
        self.size = len(self.chars) // 2

    def edit(self, start: int, end: int, replacement: str) -> None:
        """Replace the characters from ``start`` up to ``end`` of the text as it now is."""
        if not 0 <= start <= end <= self.n_chars:
            raise ValueError(f"no characters {start} to {end} in a text of {self.n_chars}")
        first, begins = self._find(start)
        before = self.leaves[first][: start - begins]
        while first and (len(before) < LOOK_AHEAD or not before.strip()):
            first -= 1
            begins -= len(self.leaves[first])
            before = self.leaves[first] + before
        last, _ = self._find(max(start, end - 1))
        old = "".join(self.leaves[first : last + 1])
        new = old[: start - begins] + replacement + old[end - begins :]
        bounds = {len(new): last + 1}  # where old leaves start, in the new text
        while True:
            if last + 1 >= len(self.leaves):
                self._put(first, last + 1, self.counter.cut(new))
                return
            found = self._meeting(new, bounds)
            if found:
                self._put(first, found[1], found[0])
                return
            for _ in range(len(bounds)):
                if last + 1 < len(self.leaves):
                    last += 1
                    new += self.leaves[last]
                    bounds[len(new)] = last + 1

    def _meeting(self, new: str, bounds: dict[int, int]) -> tuple[list[str], int] | None:
        """Pre-tokens up to the first old leaf's start that is also a new one's, if the text so far settles it."""
        at, pieces = 0, self.counter.cut(new)
        settled = len(new.rstrip()) - LOOK_AHEAD
        for k, p in enumerate(pieces):
            at += len(p)
            if at > settled:
                return None
            if at in bounds:
                return pieces[: k + 1], bounds[at]
        return None


#: Personal data and secrets that the cleaning rule masks.
MASKS = (
    (re.compile(r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"), "<EMAIL>"),
    (re.compile(r"\b\d{1,3}(?:\.\d{1,3}){3}\b"), "<IP>"),
    (re.compile(r"\b\d{16}\b"), "<CARD>"),
    (re.compile(r'token = "[0-9a-f]{16,}"'), "<SECRET>"),
)


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits that mask personal data and secrets and take out lines equal to an earlier line, from the end backwards."""
    found: list[tuple[int, int, str]] = []
    at, seen, gone = 0, set(), []
    for line in text.split("\n"):
        if line.strip() and line in seen:
            gone.append((max(0, at - 1), at + len(line), ""))
        seen.add(line)
        at += len(line) + 1
    for pattern, mask in MASKS:
        found += [(m.start(), m.end(), mask) for m in pattern.finditer(text)]
    # a line that goes takes its masks with it; no mask spans lines, so the last line begun at its start decides
    begins = [start for start, _, _ in gone]
    inside = lambda start, end: (k := bisect_right(begins, start)) > 0 and end <= gone[k - 1][1]
    found = [e for e in found if not inside(e[0], e[1])]
    edits, free = [], len(text) + 1
    for start, end, by in sorted(gone + found, key=lambda e: (-e[0], -e[1])):
        if end <= free:
            edits.append((start, end, by))
            free = start
    return edits


def read_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary's bytes, read on the driver and sent to the executors: its size doesn't follow the input."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def count_trees(docs: DataFrame, vocabulary: Broadcast, pattern: str = PRE_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, n_pieces, chars, tokens`` for every row: its pre-tokens, and the trees of their sums (the text's
    tokens are ``tokens[1]``). Write it, and edits go on from it.

    A null text counts as an empty one. Very long texts have larger trees. Repeated rows each have a tree. An empty
    table gives an empty result. Other columns of ``docs`` aren't read.
    """

    @F.pandas_udf("n_pieces long, chars array<int>, tokens array<int>")
    def grown(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counter = PieceCounter(vocabulary.value, pattern)
        for texts in batches:
            yield pd.DataFrame([CountTree.sums_of(t or "", counter) for t in texts], columns=["n_pieces", "chars", "tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), grown(text).alias("grown")).select("doc_id", "text", "grown.*")


def edit_trees(trees: DataFrame, vocabulary: Broadcast, rule: Callable[[str], list[tuple[int, int, str]]] | None = cleaning_edits, edits_col: str | None = None, pattern: str = PRE_TOKENS, keep_trees: bool = True) -> DataFrame:
    """``trees`` after their edits, with ``n_edits, n_skipped, n_reencoded``; without their ``text, chars, tokens`` but
    with ``n_tokens, n_chars`` unless ``keep_trees``.

    Edits are those of ``rule(text)``, or of the column ``edits_col`` (array of struct start, end, replacement);
    each counts characters in the text that the one before it left. An edit outside its text, or with a null place, is
    skipped and counted as such; a null replacement is empty, and null edits are none. ``n_reencoded`` are the
    pre-tokens that were encoded. A tree without edits is passed on as it is.
    """
    counts = "n_tokens long, n_chars long, n_edits long, n_skipped long, n_reencoded long"
    kinds = counts + (", text string, chars array<int>, tokens array<int>" if keep_trees else "")

    def one(text: str, chars, tokens, edits, counter: PieceCounter) -> tuple:
        edits = [tuple(e.values()) if isinstance(e, dict) else tuple(e) for e in edits] if edits is not None else (rule(text) if rule else [])
        if not edits:
            return (tokens[1], chars[1], 0, 0, 0, text, chars, tokens)
        tree, skipped = CountTree(text, [int(x) for x in chars], [int(x) for x in tokens], counter), 0
        for start, end, by in edits:
            if any(x is None or x != x for x in (start, end)) or not 0 <= start <= end <= tree.n_chars:
                skipped += 1
            else:
                tree.edit(int(start), int(end), by or "")
        return (tree.n_tokens, tree.n_chars, len(edits) - skipped, skipped, tree.reencoded, tree.text() if keep_trees else None, tree.chars, tree.tokens)

    @F.pandas_udf(kinds)
    def edited(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        counter, names = PieceCounter(vocabulary.value, pattern), [c.split()[0] for c in kinds.split(", ")]
        for columns in batches:
            rows = [one(*row, counter)[: len(names)] for row in zip(*columns, strict=True)]
            yield pd.DataFrame(rows, columns=names).astype({c: "int64" for c in names[:5]})

    edits = F.col(edits_col) if edits_col else F.lit(None).cast("array<struct<start:int,end:int,replacement:string>>")
    made = trees.select("doc_id", "n_pieces", edited("text", "chars", "tokens", edits).alias("made")).select("doc_id", "n_pieces", "made.*")
    return made.select("doc_id", "text", "n_pieces", "chars", "tokens", "n_edits", "n_skipped", "n_reencoded") if keep_trees else made


def recount(docs: DataFrame, rule: Callable[[str], list[tuple[int, int, str]]] | None = cleaning_edits, edits_col: str | None = None, vocabulary: str = VOCABULARY, pattern: str = PRE_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens of every whole text before and after its edits: ``doc_id, n_tokens, n_pieces, n_edits, n_skipped,
    n_tokens_edited, n_chars_edited, n_reencoded``.

    The trees are written before they are edited, so texts are encoded once; see ``count_trees`` and ``edit_trees`` for
    nulls, edits that don't fit and the rest. ``vocabulary`` is a path that the driver can open.
    """
    shipped = read_vocabulary(docs.sparkSession, vocabulary)
    trees = count_trees(docs, shipped, pattern, id_col, text_col)
    if edits_col:
        trees = count_trees(docs.select(F.struct(F.col(id_col).alias("id"), F.col(edits_col).alias("edits")).alias("both"), F.col(text_col).alias("text")), shipped, pattern, "both", "text").select("doc_id.id", "doc_id.edits", "text", "n_pieces", "chars", "tokens").withColumnRenamed("id", "doc_id")
    kept = written(trees, "count-trees")
    with_before = kept.withColumn("doc_id", F.struct("doc_id", F.get("tokens", F.lit(1)).cast("long").alias("n_tokens")))
    got = edit_trees(with_before, shipped, rule, "edits" if edits_col else None, pattern, keep_trees=False)
    return got.select("doc_id.doc_id", "doc_id.n_tokens", "n_pieces", "n_edits", "n_skipped", F.col("n_tokens").alias("n_tokens_edited"), F.col("n_chars").alias("n_chars_edited"), "n_reencoded")
