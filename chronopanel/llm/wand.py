"""Ranked search by variable-block-max WAND.

One pass over the documents keeps of each its length and the counts of the terms that the queries ask for, written to the shared folder; from it come the
corpus statistics. A task then builds shards of its rows, of a bounded number of postings each, and searches them, so no posting is shuffled:

* A posting's gain (its part of a score but for the term's weight) is known once the statistics are. Dynamic programming cuts each term's
  postings, in document order, into blocks so that the sum of the bound errors (a block's largest gain less the gain, over its postings) and of a
  fixed cost for each block is the least, over all blocks of at most ``most_in_block`` postings.
* A query's blocks split the shard into ranges of documents; the bound of a range is the sum of its blocks' largest gains by weight. Ranges are
  visited from the greatest bound down, and only the blocks that overlap them are read. Search stops at the first bound below the worst score held,
  so what is skipped can't enter the result. A task's results go on from shard to shard, so later shards start with a high threshold.

Queries are taken in blocks of a bounded number of terms. What a task returns is at most k rows for each query; they are merged in two steps.

Scores are 64-bit integers, see ``weights`` and ``gains``. Ties go to the smaller doc_id, null last. Null texts have no terms; documents without terms count
for nothing. Rows with equal or null ids are separate documents, and rows of queries with equal or null ids separate queries. Very long texts are
read whole. Only doc_id, text and item_id are read, so other columns can't clash. An empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm.common import batches, kept, remove, rows_of, texts, type_of, written

#: Bytes that end a term become spaces, capitals A-Z small letters; all others, those of longer characters included, stay.
TABLE = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
FORWARD = "n bigint, terms array<int>, counts array<int>"


def terms(text: str) -> list[bytes]:
    return text.encode().translate(TABLE).split()


def forward(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), terms and counts (those of the vocabulary, by number) of each document with a term."""
    ddl = f"doc_id {type_of(docs, 'doc_id')}, {FORWARD}"

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in it:
                for doc_id, text in rows_of(batch, "doc_id", "text"):
                    if found := terms(text):
                        known = [(vocabulary[t], c) for t, c in Counter(found).items() if t in vocabulary]
                        pair = np.array(known, np.int32).reshape(-1, 2)
                        yield doc_id, len(found), pair[:, 0], pair[:, 1]

        yield from batches(rows(), ddl, 500)

    return texts(docs, "doc_id").mapInArrow(scan, ddl)


def weights(df: dict[int, int], n_docs: int, size: int) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) by term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(t, 0) + 1))) for t in range(size)], np.int64)


def gains(tf: np.ndarray, n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """1000000000 tf div (1000 tf + 8 m), where m is 25 + 75 n N div L."""
    tf = tf.astype(np.int64)
    return 1_000_000_000 * tf // (1000 * tf + 8 * (25 + 75 * n * n_docs // n_terms))


def cut_points(gain: np.ndarray, starts: np.ndarray, block_cost: int, most: int, run: int = 4096, lanes: int = 512) -> np.ndarray:
    """First postings of the blocks: for each list (``starts``, with the end) those of least bound error and cost.

    best[j] = min over i of best[i] + cost + (j - i) * max(i..j) - sum(i..j). All beginnings i of the last ``most`` are kept side by side with their
    running maxima, and ``lanes`` lists move on together. Lists longer than ``run`` are cut there first.
    """
    begin = np.concatenate([np.arange(a, b, run) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)] or [np.empty(0, np.int64)])
    length = np.diff(np.append(begin, starts[-1]))
    first = np.zeros(len(gain), bool)
    first[begin] = True
    order = np.argsort(-length, kind="stable")
    for at in range(0, len(order), lanes):
        lists = order[at : at + lanes]
        of, size = begin[lists], length[lists]
        longest, width = int(size[0]), len(lists)
        if longest < 2:
            break
        came = np.zeros((longest + 1, width), np.int32)
        top, base, steps = np.zeros((most, width)), np.full((most, width), np.inf), np.zeros((most, 1))
        best, total = np.zeros(width), np.zeros(width)
        for j in range(longest):
            w = int(np.searchsorted(-size, -j, "left"))  # lists that go on, as they come longest first
            slot, k = j % most, min(j + 1, most)
            base[slot, :w], top[slot, :w], steps[slot] = best[:w] + total[:w], 0, 0
            steps[:k] += 1
            g = gain[of[:w] + j]
            total[:w] += g
            np.maximum(top[:k, :w], g, out=top[:k, :w])
            cost = top[:k, :w] * steps[:k]
            cost += base[:k, :w]
            i = cost.argmin(0)
            best[:w] = cost[i, np.arange(w)] - total[:w] + block_cost
            came[j + 1, :w] = j + 1 - steps[i, 0].astype(np.int32)
        now, live = size.astype(np.int64), np.arange(width)
        while len(live):
            now[live] = came[now[live], live]
            first[of[live] + now[live]] = True
            live = live[now[live] > 0]
    return np.flatnonzero(first)


class Shard:
    """Postings of some documents by term, in blocks."""

    def __init__(self, ids: list, n: np.ndarray, sizes: np.ndarray, term: np.ndarray, count: np.ndarray, n_docs: int, n_terms: int, block_cost: int, most_in_block: int):
        self.ids, self.size = ids, len(ids)
        doc = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        order = np.argsort(term, kind="stable")
        term, self.doc = term[order], doc[order]
        self.gain = gains(count[order], n[self.doc], n_docs, n_terms)
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        at = cut_points(self.gain, np.append(starts, len(term)), block_cost, most_in_block) if len(term) else starts
        self.start, self.length = at, np.diff(np.append(at, len(term)))
        self.most = np.maximum.reduceat(self.gain, at) if len(at) else at
        self.low, self.high = self.doc[at], self.doc[at + self.length - 1] + 1
        self.term = term[at]
        self.first_of = {t: a for t, a in zip(term[starts].tolist(), np.searchsorted(at, starts).tolist(), strict=True)}
        self.ends = np.append(np.flatnonzero(np.diff(self.term)) + 1, len(at)) if len(at) else at
        self.end_of = dict(zip(self.first_of, self.ends.tolist(), strict=True))

    def search(self, query: dict[int, int], k: int, held: list[tuple]) -> list[tuple]:
        """The k best of ``held`` and this shard's documents: tuples (-score, id is null, id). ``query``: weight by term."""
        known = [t for t in query if query[t] and t in self.first_of]
        if not known:
            return held
        b = np.concatenate([np.arange(self.first_of[t], self.end_of[t]) for t in known])
        weight = np.repeat(np.array([query[t] for t in known], np.int64), [self.end_of[t] - self.first_of[t] for t in known])
        low, high, most = self.low[b], self.high[b], self.most[b] * weight
        edges = np.unique(np.concatenate([low, high]))
        bound = np.zeros(len(edges), np.int64)
        np.add.at(bound, np.searchsorted(edges, low), most)
        np.subtract.at(bound, np.searchsorted(edges, high), most)
        bound = np.cumsum(bound)[:-1]
        order, done, group = np.argsort(-bound, kind="stable"), 0, 4 * k
        while done < len(order):
            worst = -held[-1][0] if len(held) == k else 1
            chosen = order[done : done + group]
            chosen = chosen[bound[chosen] >= worst]
            if not len(chosen):
                break
            done, group = done + len(chosen), len(order)  # the first ranges make a threshold, then one reading does
            held = self.read(b, weight, low, high, edges[chosen], edges[chosen + 1], worst, k, held)
        return held

    def read(self, b, weight, low, high, begin, end, worst: int, k: int, held: list[tuple]) -> list[tuple]:
        """``held`` with what is in the document ranges, from the blocks that overlap them."""
        step = np.zeros(self.size + 1, np.int8)
        step[begin] += 1
        step[end] -= 1  # a document can end one range and begin another
        wanted = np.cumsum(step[:-1], dtype=np.int8) > 0
        before = np.concatenate([[0], np.cumsum(wanted)])
        live = before[high] > before[low]
        at, size = self.start[b[live]], self.length[b[live]]
        posting = np.arange(size.sum()) + np.repeat(at - (np.cumsum(size) - size), size)
        score = np.zeros(self.size, np.int64)
        np.add.at(score, self.doc[posting], self.gain[posting] * np.repeat(weight[live], size))
        found = np.flatnonzero(wanted & (score >= worst))
        if len(found) > k:
            found = found[score[found] >= np.partition(score[found], len(found) - k)[len(found) - k]]
        new = [(-s, self.ids[d] is None, self.ids[d]) for d, s in zip(found.tolist(), score[found].tolist(), strict=True)]
        return sorted(held + new, key=lambda r: (r[0], r[1], 0 if r[1] else r[2]))[:k]


def shards(it: Iterator[pa.RecordBatch], most_postings: int, **made) -> Iterator[Shard]:
    """Shards of consecutive rows of ``forward``, with ``most_postings`` or one batch more."""
    parts, held = [], 0

    def shard():
        column = lambda name: [p.column(p.schema.get_field_index(name)) for p in parts]
        flat = lambda name: np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column(name)])
        sizes = np.concatenate([c.value_lengths().to_numpy(zero_copy_only=False) for c in column("terms")])
        ids = [x for c in column("doc_id") for x in c.to_pylist()]
        return Shard(ids, np.concatenate([c.to_numpy() for c in column("n")]), sizes, flat("terms"), flat("counts"), **made)

    for batch in it:
        parts.append(batch)
        held += len(batch.column(batch.schema.get_field_index("terms")).flatten())
        if held >= most_postings:
            yield shard()
            parts, held = [], 0
    if parts:
        yield shard()


def search(rows: DataFrame, queries: list[tuple], k: int, weight: np.ndarray, item_type: str, most_postings: int, **made) -> DataFrame:
    """item, item_id, doc_id, score, task: at most k rows for each task and query. ``queries``: number, id and term counts of each."""
    ddl = f"item bigint, item_id {item_type}, doc_id {type_of(rows, 'doc_id')}, score bigint, task int"
    asked = [(q, item_id, {t: c * int(weight[t]) for t, c in of.items()}) for q, item_id, of in queries]

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {q: [] for q, _, _ in asked}
        for shard in shards(it, most_postings, **made):
            for q, _, of in asked:
                best[q] = shard.search(of, k, best[q])
        task = TaskContext.get().partitionId()
        yield from batches(((q, item_id, r[2], -r[0], task) for q, item_id, _ in asked for r in best[q]), ddl)

    return rows.mapInArrow(each, ddl)


def merged(found: DataFrame, k: int, groups: int = 256) -> DataFrame:
    """The k best for each query, with their rank: by groups of tasks first, so no task gets what all tasks found for a query."""
    by = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = found.withColumn("part", F.pmod("task", F.lit(groups)))
    some = part.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*by))).where(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*by))).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def query_blocks(queries: DataFrame, most_terms: int) -> Iterator[list[tuple]]:
    """Lists of (number, item_id, term counts), of ``most_terms`` distinct terms together or one query more. The driver holds one at a time."""
    block, held = [], 0
    for number, row in enumerate(texts(queries, "item_id").toLocalIterator()):
        of = Counter(terms(row["text"]))
        if of:
            block.append((number, row["item_id"], of))
            held += len(of)
        if held >= most_terms:
            yield block
            block, held = [], 0
    if block:
        yield block


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10, most_terms: int = 200_000, most_postings: int = 2_000_000, block_cost: int = 2_000_000, most_in_block: int = 128) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 for each row of ``queries`` (item_id, text)."""
    item_type, results = type_of(queries, "item_id"), []
    for block in query_blocks(queries, most_terms):
        vocabulary = {t: i for i, t in enumerate(sorted({t for _, _, of in block for t in of}))}
        rows, path = kept(forward(docs, vocabulary), "postings")
        n_docs, n_terms = rows.agg(F.count("*"), F.sum("n")).first()
        if n_docs:
            df = {r["term"]: r["count"] for r in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}  # at most a block's terms
            numbered = [(q, item_id, {vocabulary[t]: c for t, c in of.items()}) for q, item_id, of in block]
            found = search(rows, numbered, k, weights(df, n_docs, len(vocabulary)), item_type, most_postings, n_docs=n_docs, n_terms=n_terms, block_cost=block_cost, most_in_block=most_in_block)
            results.append(written(merged(found, k), "ranked"))
        remove(docs.sparkSession, path)
    empty = docs.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id {type_of(docs, 'doc_id')}, score bigint")
    return reduce(DataFrame.unionByName, results, empty)
