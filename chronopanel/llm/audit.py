"""Audit of how document filters interact: what each filter removes in every order, and what it alone removes.

Every document gets a bit for each filter that it fails:

A fewer than 200 words, B fewer than half of the words distinct, C more than 2% capitals A-Z, D any of # $ % & * |, E the text of a document with
a smaller id. Words are runs of characters other than space and U+0009 to U+000D.

Duplicates are found by refining a partition of the documents. They are split by their length in code points, then by the hash of one block of
the text after the other; a class with one document is dropped at once and its later blocks don't matter. Classes are refined as rows of counts
(copies are summed in their task before any shuffle), so a group of copies, however large, is one row of each task. Whole texts are compared only
in the classes that are left: grouped by text, again after a sum in the task. A class all of whose texts are equal gives its smallest id to its
rows; one in which hashes collided is resolved by text.

Documents are then counted by part and mask, at most 32 rows for each part, and all orders are read off these counts.

Null texts are empty, and equal to empty ones. A null part is the empty string. A null id is greater than all others and equal to itself, so of
rows with equal texts, those with the smallest id (all of them, if repeated) don't fail E. Labels with repeated ids count as 1 if any of
them is 1. Very long texts are read whole. Only the named columns are read, so other columns can't clash. No documents give no rows.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import MOST_BROADCAST, batches, cut, rows_of, small, type_of

FILTERS = "ABCDE"
DUPLICATE = 1 << FILTERS.index("E")
MARKS = b"#$%&*|"
CAPITALS = string.ascii_uppercase.encode()
#: Ends of the blocks, in code points; the last block is the rest.
BLOCKS = (64, 1024)
SPLITS = ["n_chars", *[f"block_{i}" for i in range(len(BLOCKS) + 1)]]


def failed(text: str) -> int:
    """The bits of A to D."""
    data = text.encode()
    words = data.split()
    few, alike = len(words) < 200, 2 * len(set(words)) < len(words)
    loud = 100 * (len(data) - len(data.translate(None, CAPITALS))) > 2 * len(text)
    return few | alike << 1 | loud << 2 | (len(data.translate(None, MARKS)) < len(data)) << 3


def split_keys(text: Column, hash_bits: int = 64) -> dict[str, Column]:
    """Length and block hashes. Fewer ``hash_bits`` than 64 make hashes collide, for tests."""
    edges = [0, *BLOCKS]
    parts = [F.substring(text, a + 1, b - a) for a, b in zip(edges, edges[1:], strict=False)] + [F.substring(text, edges[-1] + 1, 2**31 - 1 - edges[-1])]
    return {"n_chars": F.char_length(text), **{f"block_{i}": F.shiftrightunsigned(F.xxhash64(p), 64 - hash_bits) for i, p in enumerate(parts)}}


def keyed(docs: DataFrame, part: str, hash_bits: int) -> DataFrame:
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumns(split_keys(F.col("text"), hash_bits))


def masked(rows: DataFrame, *more: str) -> DataFrame:
    """doc_id, part, the split keys, ``more`` (booleans) and ``mask`` (bits A to D); texts stay in the task."""
    kept = ["doc_id", "part", *SPLITS, *more]
    ddl = f"doc_id {type_of(rows, 'doc_id')}, part string, n_chars int, {', '.join(f'{k} bigint' for k in SPLITS[1:])}, {''.join(f'{k} boolean, ' for k in more)}mask int"

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(((*row[:-1], failed(row[-1])) for b in it for row in rows_of(b, *kept, "text")), ddl)

    return rows.select(*kept, "text").mapInArrow(each, ddl)


def refined(rows: DataFrame) -> DataFrame:
    """The classes (split keys) that hold several documents after every split."""
    classes = cut(rows.groupBy(*SPLITS).agg(F.count("*").alias("n")))
    for depth in range(1, len(SPLITS)):
        several = classes.groupBy(*SPLITS[:depth]).agg(F.sum("n").alias("in_class")).where("in_class > 1").drop("in_class")
        classes = classes.join(several, SPLITS[:depth], "left_semi")
    return classes.where("n > 1").select(*SPLITS)


def after(first: Column) -> Column:
    """Whether doc_id is greater than ``first`` (the least of a group's ids, null if all are), null being the greatest."""
    return F.coalesce(F.col("doc_id") > first, F.col("doc_id").isNull() & first.isNotNull())


def with_masks(docs: DataFrame, part: str = "source", hash_bits: int = 64) -> DataFrame:
    """doc_id, part, mask: all five bits, a row for each document."""
    texts_of = keyed(docs, part, hash_bits)
    rows = cut(masked(texts_of))
    classes = small(cut(refined(rows)))
    by_text = texts_of.join(classes, SPLITS, "left_semi").groupBy(*SPLITS, "text").agg(F.min("doc_id").alias("first_id"))
    found = cut(by_text.groupBy(*SPLITS).agg(F.count("*").alias("n_texts"), F.min("first_id").alias("first_id")))
    done = rows.join(small(found), SPLITS, "left").withColumn("repeated", (F.col("n_texts") == 1) & after(F.col("first_id")))
    if torn := found.where("n_texts > 1").count():  # hashes collided there: these rows by their texts
        apart = found.where("n_texts > 1").select(*SPLITS)
        again = texts_of.join(F.broadcast(apart) if torn <= MOST_BROADCAST else apart, SPLITS, "left_semi")
        firsts = again.groupBy("text").agg(F.min("doc_id").alias("first_id"))
        resolved = masked(again.join(firsts, "text").withColumn("repeated", after(F.col("first_id"))), "repeated")
        done = done.where("n_texts IS NULL OR n_texts = 1").select("doc_id", "part", "mask", "repeated").unionByName(resolved.select("doc_id", "part", "mask", "repeated"))
    return done.select("doc_id", "part", (F.col("mask") + F.when(F.col("repeated"), DUPLICATE).otherwise(0)).alias("mask"))


def counted(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: how many documents, and how many with quality 1 and with toxic 1."""
    one = lambda c: F.max((F.coalesce(F.col(c), F.lit(0)) == 1).cast("int")).alias(f"is_{c}")
    of = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(one("quality"), one("toxic"))
    return rows.join(of, "doc_id", "left").groupBy("part", "mask").agg(F.count("*").alias("n"), F.coalesce(F.sum("is_quality"), F.lit(0)).alias("good"), F.coalesce(F.sum("is_toxic"), F.lit(0)).alias("toxic"))


def orders() -> list[tuple[str, int, int, int]]:
    """(order, step, bits of the filters before it, its own bit)."""
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    return [("".join(o), k + 1, sum(bit[f] for f in o[:k]), bit[o[k]]) for o in permutations(FILTERS) for k in range(len(FILTERS))]


def audited(counts: DataFrame) -> DataFrame:
    """A row for each part, order and step, from ``counted``.

    What a step does depends on its filter and the set of those before it alone: a part's masks are met with these 80 pairs, and the orders
    with the sums. A document with k failures is removed by each of them in 120 / k orders.
    """
    pairs = sorted({(before, own) for _, _, before, own in orders()})
    each = counts.withColumn("p", F.explode(F.array(*[F.struct(F.lit(b).alias("before"), F.lit(o).alias("own")) for b, o in pairs]))).select("*", "p.before", "p.own")
    fails, earlier = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0))
    share = F.col("n") * F.expr(f"{len(list(permutations(FILTERS)))} div greatest(bit_count(mask), 1)")
    sums = each.groupBy("part", "before", "own").agg(
        total("n", ~fails & ~earlier).alias("kept"),
        total("n", fails & ~earlier).alias("removed"),
        total("n", fails & earlier).alias("redundant"),
        total("n", F.col("mask") == F.col("own")).alias("unique_fails"),
        total("good", fails & ~earlier).alias("good_lost"),
        total("toxic", fails & ~earlier).alias("toxic_lost"),
        F.coalesce(F.sum(F.when(fails, share)), F.lit(0)).alias("shapley"),
    )
    table = counts.sparkSession.createDataFrame(orders(), "filter_order string, step int, before int, own int")
    steps = sums.join(F.broadcast(table), ["before", "own"])  # 600 rows, fixed
    return steps.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    return audited(counted(with_masks(docs, part), labels))
