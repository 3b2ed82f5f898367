"""Bounded-space online packing of documents into sequences.

A task reads its partition once and keeps at most ``most_open`` windows. A document goes into the fullest window that has room for all of it
(best fit). If none has, and no further window may be opened, the fullest is topped up with the document's head and emitted, and what is
left of the document is placed in the same way. Documents of a window's size or more first give whole windows of their own.

The windows still open at the end of each partition, ``most_open`` at most, are leftovers: their pieces, with their ids, are dealt to far
fewer tasks that pack them in the same way, until one task has few enough windows for all (so many rounds as the logarithm of the partitions).
It merges the emptiest window into the rest until one is left, which is cut into lengths that are powers of two and need no padding. So every
other sequence is full, and no task ever holds more than its open windows and one document.

Null texts count as empty (one token, the separator). Rows with equal or null ids and repeated rows are separate documents; ids may be of any
type. Very long texts are tokenised whole. Ties between windows go to the one opened first. Only doc_id and text are read, so other columns
can't clash. An empty table gives an empty result. Each round is written to the shared folder before the next reads it, so a lost executor
never makes two rounds disagree about a cut.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import batches, rows_of, texts, type_of, written
from chronopanel.llm.packing import RANKS, SEPARATOR, encoder

PIECE = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, open boolean, ids binary"

Piece = tuple  # doc_id, start, ids, doc_tokens


class Windows:
    """The open windows of a task. ``add`` and ``merged`` yield (sequence, pieces) of every window that is done."""

    def __init__(self, size: int, most_open: int, first: int):
        self.size, self.most_open, self.next = size, most_open, first
        self.open: list[list] = []  # [used, sequence, pieces]

    def opened(self) -> list:
        self.next += 1
        self.open.append([0, self.next - 1, []])
        return self.open[-1]

    def put(self, window: list, piece: Piece) -> Iterator[tuple[int, list[Piece]]]:
        window[0] += len(piece[2])
        window[2].append(piece)
        if window[0] == self.size:
            self.open.remove(window)
            yield window[1], window[2]

    def add(self, piece: Piece) -> Iterator[tuple[int, list[Piece]]]:
        doc_id, start, ids, of = piece
        while len(ids):
            n, at = len(ids), None
            if n < self.size:
                at = max((w for w in self.open if w[0] + n <= self.size), key=lambda w: w[0], default=None)
                if at is None and len(self.open) >= self.most_open:
                    at = max(self.open, key=lambda w: w[0])
            if at is None:
                at = self.opened()
            k = min(n, self.size - at[0])
            yield from self.put(at, (doc_id, start, ids[:k], of))
            start, ids = start + k, ids[k:]

    def merged(self) -> Iterator[tuple[int, list[Piece]]]:
        """Empties all windows: the emptiest goes into the others, again and again; the last is cut at powers of two."""
        while len(self.open) > 1:
            least = min(self.open, key=lambda w: w[0])
            self.open.remove(least)
            self.most_open = len(self.open)
            for piece in least[2]:
                yield from self.add(piece)
            self.most_open = max(1, len(self.open))
        for used, _, pieces in self.open[:]:
            self.open.clear()
            full = self.size
            while pieces:
                self.size = 1 << used.bit_length() - 1
                at, rest = self.opened(), []
                for doc_id, start, ids, of in pieces:
                    k = min(len(ids), self.size - at[0])
                    if k:
                        yield from self.put(at, (doc_id, start, ids[:k], of))
                    if k < len(ids):
                        rest.append((doc_id, start + k, ids[k:], of))
                used, pieces = used - self.size, rest
            self.size = full


def rows_of_window(sequence: int, pieces: list[Piece], is_open: bool, with_ids: bool) -> Iterator[tuple]:
    offset = 0
    for doc_id, start, ids, of in pieces:
        data = ids.tobytes()
        yield doc_id, start, len(ids), zlib.crc32(data), of, sequence, offset, is_open, data if is_open or with_ids else None
        offset += len(ids)


def one_round(rows: DataFrame, columns: list[str], pieces_of, number: int, size: int, most_open: int, last: bool, with_ids: bool) -> DataFrame:
    """Every task packs its rows with windows of its own. ``pieces_of`` makes an iterator of pieces from one of rows."""
    ddl = f"doc_id {type_of(rows, 'doc_id')}, {PIECE}"

    def pack_part(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(size, most_open, (number << 56) + (TaskContext.get().partitionId() << 32))

        def done():
            for piece in pieces_of(row for b in it for row in rows_of(b, *columns)):
                yield from windows.add(piece)
            if last:
                yield from windows.merged()

        def out():
            for sequence, pieces in done():
                yield from rows_of_window(sequence, pieces, False, with_ids)
            for _, sequence, pieces in windows.open:
                yield from rows_of_window(sequence, pieces, True, with_ids)

        yield from batches(out(), ddl)

    return written(rows.mapInArrow(pack_part, ddl), "online-packing")


def pack_online(docs: DataFrame, size: int = 1024, most_open: int = 32, fan_in: int = 64, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of every document (and ``ids``: unsigned 32-bit, little-endian)."""
    if fan_in < 2:
        raise ValueError("a round must merge the windows of at least two tasks into one")
    path = vocabulary or public_tokenizers.path(RANKS)

    def tokenised(rows):
        encode = encoder(path)
        for doc_id, text in rows:
            ids = np.array([*encode(text), SEPARATOR], dtype="<u4")
            yield doc_id, 0, ids, len(ids)

    def again(rows):
        return ((doc_id, start, np.frombuffer(ids, "<u4"), of) for doc_id, start, ids, of in rows)

    rounds = [one_round(texts(docs, "doc_id"), ["doc_id", "text"], tokenised, 0, size, most_open, False, with_ids)]
    while left := rounds[-1].where("open").agg(F.sum("length")).first()[0]:
        tasks = -(-left // (fan_in * most_open * size))
        dealt = rounds[-1].where("open").select("doc_id", "start", "ids", "doc_tokens").repartition(tasks)
        rounds.append(one_round(dealt, ["doc_id", "start", "ids", "doc_tokens"], again, len(rounds), size, most_open, tasks == 1, with_ids))
    closed = reduce(DataFrame.unionByName, [r.where("NOT open") for r in rounds])
    return closed.drop("open", *[] if with_ids else ["ids"])
