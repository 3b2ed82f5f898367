"""Token counts that follow edits.

A text is cut into segments at places where the tokenizer's pre-tokens break whatever stands around them: before a
single space between two characters that aren't white space. Tokens never cross such a place, so a text's count is
the sum of its segments' counts. Each document keeps its segments' lengths and counts as leaves of a sum tree.

An edit replaces ``length`` code points at ``start`` by a text. Descending the tree finds the leaves that it touches; they
and the leaf on either side (the boundary context) are joined, edited, cut anew and encoded anew; all other leaves
keep their counts. Edits of a document apply in order, each to the text the one before left.

A start beyond the text's end appends; a length beyond it ends there; negative values count as 0. Null texts are empty and
have no segment. Null edit lists and replacements are empty. Rows are independent; repeated rows give equal results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import batches, rows_of, type_of
from chronopanel.llm.packing import RANKS, encoder

SEGMENT = 96
BREAK = re.compile(r"(?<=\S) (?=\S)")


def segments(text: str, size: int = SEGMENT) -> list[str]:
    """Pieces of at least ``size`` code points, but the last, that end at a break."""
    out, at = [], 0
    while at < len(text):
        found = BREAK.search(text, at + size)
        end = found.start() if found else len(text)
        out.append(text[at:end])
        at = end
    return out


class SumTree:
    """Prefix sums over a list of leaves (characters, tokens) that change in place or in number."""

    def __init__(self, leaves: list[tuple[int, int]]):
        self.size = 1 << max(0, (len(leaves) - 1).bit_length())
        self.n = len(leaves)
        self.chars, self.tokens = ([0] * (2 * self.size) for _ in range(2))
        for k, (c, t) in enumerate(leaves):
            self.chars[self.size + k], self.tokens[self.size + k] = c, t
        for k in range(self.size - 1, 0, -1):
            self.pull(k)

    def pull(self, k: int) -> None:
        self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]
        self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds the character, and where that leaf starts; the last leaf beyond the end."""
        if char >= self.chars[1]:
            return self.n - 1, self.chars[1] - self.chars[self.size + self.n - 1]
        k, start = 1, 0
        while k < self.size:
            k *= 2
            if char - start >= self.chars[k]:
                start += self.chars[k]
                k += 1
        return k - self.size, start

    def leaf(self, k: int) -> tuple[int, int]:
        return self.chars[self.size + k], self.tokens[self.size + k]

    def leaves(self) -> list[tuple[int, int]]:
        return [self.leaf(k) for k in range(self.n)]

    def put(self, k: int, leaf: tuple[int, int]) -> None:
        k += self.size
        self.chars[k], self.tokens[k] = leaf
        while k > 1:
            k //= 2
            self.pull(k)


class Counted:
    """A text with the sum tree of its segments."""

    def __init__(self, text: str, encode, leaves: list[tuple[int, int]] | None = None):
        self.text, self.encode, self.encoded_chars = text, encode, 0
        self.tree = SumTree(self.count(segments(text)) if leaves is None else leaves)

    def count(self, parts: list[str]) -> list[tuple[int, int]]:
        self.encoded_chars += sum(map(len, parts))
        return [(len(p), len(self.encode(p))) for p in parts]

    @property
    def tokens(self) -> int:
        return self.tree.tokens[1]

    def edit(self, start: int, length: int, replacement: str) -> None:
        start = min(max(start, 0), len(self.text))
        end = min(start + max(length, 0), len(self.text))
        if not self.tree.n:
            self.text = replacement
            self.tree = SumTree(self.count(segments(replacement)))
            return
        first, at = self.tree.find(start)
        last, last_at = self.tree.find(max(start, end - 1))
        if first:
            first -= 1
            at -= self.tree.leaf(first)[0]
        to = last_at + self.tree.leaf(last)[0]
        if last + 1 < self.tree.n:
            last += 1
            to += self.tree.leaf(last)[0]
        fresh = self.count(segments(self.text[at:start] + replacement + self.text[end:to]))
        self.text = self.text[:start] + replacement + self.text[end:]
        if len(fresh) == last - first + 1:
            for k, leaf in enumerate(fresh):
                self.tree.put(first + k, leaf)
        else:
            leaves = self.tree.leaves()
            self.tree = SumTree(leaves[:first] + fresh + leaves[last + 1 :])


EDITS = "array<struct<start:bigint,length:bigint,replacement:string>>"


def trees(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, text, leaf_chars, leaf_tokens: each document's leaves, for ``edited``."""
    vocabulary = vocabulary or public_tokenizers.path(RANKS)
    ddl = f"doc_id {type_of(docs, 'doc_id')}, text string, leaf_chars array<bigint>, leaf_tokens array<bigint>"

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)

        def rows():
            for batch in it:
                for doc_id, text in rows_of(batch, "doc_id", "text"):
                    leaves = Counted(text, encode).tree.leaves()
                    yield doc_id, text, [x[0] for x in leaves], [x[1] for x in leaves]

        yield from batches(rows(), ddl, 500)

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(each, ddl)


def edited(docs: DataFrame, vocabulary: str | None = None, keep_trees: bool = False) -> DataFrame:
    """Counts before and after the ``edits`` of each row.

    ``docs`` has doc_id, text, edits (array of start, length, replacement), and leaf_chars and leaf_tokens where the trees are
    kept. Returns doc_id, n_tokens, n_segments, edited_tokens, edited_segments, n_edits, edited_chars, encoded_chars (code points
    encoded for the edits); with ``keep_trees`` also the edited text and its leaves.
    """
    vocabulary = vocabulary or public_tokenizers.path(RANKS)
    known = {"leaf_chars", "leaf_tokens"} <= set(docs.columns)
    ddl = f"doc_id {type_of(docs, 'doc_id')}, n_tokens bigint, n_segments bigint, edited_tokens bigint, edited_segments bigint, n_edits bigint, edited_chars bigint, encoded_chars bigint"
    ddl += ", text string, leaf_chars array<bigint>, leaf_tokens array<bigint>" * keep_trees

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)

        def rows():
            for batch in it:
                for doc_id, text, edits, *leaves in rows_of(batch, "doc_id", "text", "edits", *(["leaf_chars", "leaf_tokens"] if known else [])):
                    one = Counted(text, encode, [*zip(*leaves, strict=True)] if known and leaves[0] is not None else None)
                    before = (one.tokens, one.tree.n)
                    one.encoded_chars = 0
                    for e in edits or ():
                        one.edit(e["start"] or 0, e["length"] or 0, e["replacement"] or "")
                    now = one.tree.leaves()
                    yield (doc_id, *before, one.tokens, len(now), len(edits or ()), len(one.text), one.encoded_chars, *((one.text, [x[0] for x in now], [x[1] for x in now]) if keep_trees else ()))

        yield from batches(rows(), ddl, 500 if keep_trees else 2000)

    columns = ["doc_id", F.coalesce("text", F.lit("")).alias("text"), F.col("edits").cast(EDITS).alias("edits"), *(["leaf_chars", "leaf_tokens"] if known else [])]
    return docs.select(*columns).mapInArrow(each, ddl)


def sample_edits(text: str = "text"):
    """Four edits of a text, from the text itself: a word before the start, a change at a third, a cut at two thirds, a line at the end."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t).cast("bigint")
    edit = lambda start, length, replacement: F.struct(F.floor(start).cast("bigint").alias("start"), F.lit(length).cast("bigint").alias("length"), replacement.alias("replacement"))
    return F.array(edit(F.lit(0), 0, F.lit("Revised: ")), edit(n / 3, 12, F.reverse(F.substring(t, 1, 12))), edit(2 * n / 3, 40, F.lit("")), edit(n + 1000, 0, F.concat(F.lit("\n"), F.substring(t, 1, 60))))
