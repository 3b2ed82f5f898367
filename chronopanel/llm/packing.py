"""Vector best-fit packing of documents into training sequences.

Capacities are a vector: tokens, documents, and attention cost (the sum of squared piece lengths) of a sequence. A
piece of n tokens asks for (n, 1, n * n). Pieces are packed longest first; among the open sequences that can take a
piece under every capacity, the one with the smallest weighted residual norm after placement is used (``rule="norm"``)
or the one with the largest weighted dot product of demand and residual (``rule="dot"``).

Pieces of one length are interchangeable, so the decision needs only how many pieces there are of each length: a
table of at most ``max_tokens`` rows, whatever the corpus. The driver packs that histogram, run by run of equal
sequences, and gets segments "ranks r.. of length n go to sequences s.. at offset o". Spark ranks the pieces of each
length (in buckets, so a length that a third of the corpus has is no single task's work) and joins them to the segments.

Null texts count as empty (one token, the separator). Rows with equal or null ids, and repeated rows, are separate documents; ids
may be of any type. Very long texts are tokenised whole and cut. Pieces of one length are ranked by row, so ties need no rule.
Only doc_id and text are read, so other columns can't clash. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache, partial

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm.common import batches, cut, rows_of, texts, type_of

RANKS = "byte_bpe_50k.tiktoken"
SEPARATOR = 0
BUCKET_ROWS = 50_000


#: Fixed value of the vocabulary.
SPECIAL = {"<|endoftext|>": 50256}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], list[int]]:
    """Text to ids by the byte-level BPE of byte_bpe_50k.json from its rank file: the same ids, a special token's string included, several times faster."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)
    return partial(known.encode, allowed_special="all")


def cuts(n: int, max_tokens: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than ``max_tokens``."""
    first = n % max_tokens or max_tokens
    return [(0, min(first, n)), *((s, max_tokens) for s in range(first, n, max_tokens))]


PIECE = "piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, max_tokens: int, vocabulary: str, with_ids: bool = False) -> DataFrame:
    """One row per piece of every document; with_ids adds the token ids."""
    ddl = f"doc_id {type_of(docs, 'doc_id')}, {PIECE}" + ", ids array<int>" * with_ids

    def cut_up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)

        def rows():
            for batch in it:
                for doc_id, text in rows_of(batch, "doc_id", "text"):
                    ids = np.array([*encode(text), SEPARATOR], dtype="<u4")
                    for k, (start, length) in enumerate(cuts(len(ids), max_tokens)):
                        part = ids[start : start + length]
                        yield (doc_id, k, start, length, zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else []))

        yield from batches(rows(), ddl)

    return texts(docs, "doc_id").mapInArrow(cut_up, ddl)


def plan(counts: dict[int, int], capacity: tuple[int, int, int], weights: tuple[float, float, float], rule: str) -> list[tuple[int, int, int, int, int]]:
    """Segments (length, first rank, how many, first sequence, offset) that place ``counts[n]`` pieces of each length n.

    Sequences with the same residual vector are kept as runs of consecutive numbers and take a length together, so
    the work follows the number of lengths and residuals, not the number of pieces.
    """
    cap, w = np.array(capacity, float), np.array(weights, float)
    open_runs: dict[tuple[int, int, int], list[tuple[int, int]]] = defaultdict(list)
    segments, next_sequence = [], 0

    def most(state, n):
        return min(state[0] // n, state[1], state[2] // (n * n))

    def fill(state, run, n, rank, left):
        """Puts pieces of length n into a run of sequences; returns how many, and what of the run is untouched."""
        first, size = run
        each = min(most(state, n), left)
        full = min(size, left // each)
        for k in range(each):
            segments.append((n, rank + k * full, full, first, capacity[0] - state[0] + k * n))
        rest = (state[0] - each * n, state[1] - each, state[2] - each * n * n)
        if rest[0] and rest[1] and rest[2]:
            open_runs[rest].append((first, full))
        return each * full, (first + full, size - full)

    for n in sorted(counts, reverse=True):
        left, rank, demand = counts[n], 0, np.array([n, 1, n * n], float)
        if most(capacity, n) < 1:
            raise ValueError(f"a piece of {n} tokens exceeds a capacity of {capacity}")
        while left:
            fitting = [s for s in open_runs if s[0] >= n and s[1] >= 1 and s[2] >= n * n]
            if fitting:
                residual = np.array(fitting, float)
                score = -((w * ((residual - demand) / cap) ** 2).sum(1)) if rule == "norm" else (w * (demand / cap) * (residual / cap)).sum(1)
                state = fitting[int(score.argmax())]
                runs = open_runs.pop(state)
            else:
                state, runs = capacity, [(next_sequence, -(-left // most(capacity, n)))]
                next_sequence += runs[0][1]
            while runs and left:
                done, over = fill(state, runs.pop(), n, rank, left)
                rank, left = rank + done, left - done
                if over[1]:
                    runs.append(over)
            if runs:
                open_runs[state].extend(runs)
    return segments


def ranked(df: DataFrame, most: int) -> DataFrame:
    """Adds ``rank``: 0.. without gaps among the rows of each length. ``uid`` tells rows apart."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, -(-most // max(256, min(BUCKET_ROWS, most // (8 * parts) + 1))))
    dealt = df.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "bucket").count().select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    inside = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("uid")) - 1)
    return inside.join(offsets, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before")).drop("bucket", "before")


def pack(docs: DataFrame, max_tokens: int = 2048, max_documents: int = 2048, max_attention: int = 2048 * 2048, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm", vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence and its place there."""
    packed = cut(pieces(docs, max_tokens, vocabulary or public_tokenizers.path(RANKS), with_ids).withColumn("uid", F.monotonically_increasing_id()))
    counts = {r["length"]: r["count"] for r in packed.groupBy("length").count().collect()}  # at most max_tokens rows
    segments = plan(counts, (max_tokens, max_documents, max_attention), weights, rule)
    kind = "seg_length bigint, first_rank bigint, n bigint, first_sequence bigint, offset bigint"
    table = docs.sparkSession.createDataFrame(segments, kind)
    at = (F.col("length") == F.col("seg_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("n"))
    placed = ranked(packed, max(counts.values(), default=0)).join(F.broadcast(table), at)  # bounded by lengths and residuals
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"), "offset", *["ids"] * with_ids)


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from ``pack(..., with_ids=True)``: ids in order, and each piece's start and document."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten("parts.ids").alias("ids"), F.col("parts.offset").alias("offsets"), F.col("parts.doc_id").alias("doc_ids"), F.col("parts.piece").alias("pieces"))
