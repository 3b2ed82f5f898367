"""SimHash near-duplicates by pigeonhole blocks.

``linked`` is the 64-bit operator: fingerprints at most ``max_distance`` bits apart are linked, exactly. The bits are
split into blocks; two fingerprints that differ in d bits agree on all but d blocks, so they meet under at least one
choice of ``blocks - max_distance`` blocks. Each choice is a join key; pairs that meet are verified by Hamming
distance. Equal fingerprints are collapsed first, so a group of copies is one row of the join. A key that more than
``hot`` fingerprints share isn't joined with itself: its members are linked through keys that mask two of the
remaining bits, under which at most four fingerprints meet (a few hundred rows for each member, no pairs).

``near_duplicates`` links documents by the similarity of their word shingles (a Jaccard coefficient of 0.8 on five
words by default), for which 64 bits are too coarse: it uses a 1,536-bit fingerprint of distinct shingles, 72 blocks of
20 bits, Hamming distance with three standard deviations of slack, and an exact check of what passes. Texts with the
same set of shingles are one row of all that follows. In each block every text is held against one lead, the first there,
so a group of copies makes a row for each member and block, never pairs.

Beside the blocks, an exact path finds what they miss: two texts of the similarity share a shingle among the first of each
in any one order, here that of corpus frequency (counted by hash bucket), and no filter but size and position, which lose
nothing, comes before the exact check. Here too each shingle has one lead first. The links found so far are contracted into
components; a shingle whose texts are in one component is settled, and under any other, those outside the largest component
there meet the rest (``across``). So no link between different components is lost, and a group of near copies is never
expanded into pairs. Texts that share a passage but aren't alike are told apart inside that join by 768 bits of their fingerprints
(four standard deviations of slack; texts of fewer than 16 shingles go without), so they make no rows.

Null texts are empty; texts without words have fingerprint zero, and all of them are near-duplicates of one another. Very long texts
are read whole. Null and repeated ids are kept: rows are told apart
by their fingerprints, and a component whose ids are all null has a null id. Empty tables give empty results.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations
from math import acos, ceil, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm.common import batches, cut, kept, remove, rows_of, shuffles_go, small, texts, written
from chronopanel.llm.components import components

SEED = 42
ROWS_AT_ONCE = 4096


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every run of so many words, A-Z in lower case, joined by single spaces; of fewer words, of all."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    starts = np.zeros(len(found) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1, out=starts[1:])
    n, digest = max(1, len(found) - words + 1), xxhash.xxh64_intdigest
    ends = starts[words:] - 1 if len(found) >= words else np.array([len(joined)])
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends.tolist(), strict=True)), np.uint64, n)


def mixed(h: np.ndarray, words: int) -> np.ndarray:
    """(n, words) 64-bit words from each hash: the hash itself, then SplitMix64 outputs from it."""
    with np.errstate(over="ignore"):
        z = h[:, None] + np.arange(1, words, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return np.concatenate([h[:, None], z ^ (z >> np.uint64(31))], axis=1)


def majority(h: np.ndarray, width: int) -> np.ndarray:
    """The fingerprint words: a bit is 1 if it is set in over half the hashes."""
    total = np.zeros(64 * width, np.int64)
    for at in range(0, len(h), ROWS_AT_ONCE):
        part = mixed(h[at : at + ROWS_AT_ONCE], width).astype("<u8", copy=False)
        total += np.unpackbits(part.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint16)
    return np.packbits(2 * total > len(h), bitorder="little").view("<u8")


def fingerprints(docs: DataFrame, words: int = 3, width: int = 1, distinct: bool = False, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keys`` and ``fp``, an array of ``width`` 64-bit words."""
    kinds = dict(docs.dtypes)
    ddl = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "fp array<bigint>"])

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in it:
                for *ids, text in rows_of(batch, *keys, "text"):
                    h = shingle_hashes(text, words)
                    yield (*ids, majority(np.unique(h) if distinct else h, width).view(np.int64))

        yield from batches(rows(), ddl)

    return texts(docs, *keys).mapInArrow(scan, ddl)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(blocks: int, shared: int) -> list[int]:
    """A mask for each choice of ``shared`` of the blocks of 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    of = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in combinations(of, shared)]


def close_pairs(fps: DataFrame, max_distance: int = 2, blocks: int = 4, hot: int = 1024) -> DataFrame:
    """Links (a, b) between the distinct 64-bit values of ``fp``: all of at most ``max_distance`` bits, or in hot keys as many as connect the same."""
    masks = block_masks(blocks, blocks - max_distance)
    keyed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(masks)])).alias("k")).select("fp", "k.t", "k.key")
    crowded = keyed.groupBy("t", "key").count().where(F.col("count") > hot).select("t", "key")
    a, b = (keyed.join(crowded, ["t", "key"], "left_anti").select("t", "key", F.col("fp").alias(x)) for x in "ab")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance
    pairs = a.join(b, ["t", "key"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    free = [[i for i in range(64) if not m >> i & 1] for m in masks]
    masked = F.array(*[F.array(*[F.lit(signed(sum(1 << i for i in c))) for c in combinations(bits, max_distance)]) for bits in free])
    hidden = keyed.join(crowded, ["t", "key"], "left_semi").select("fp", F.explode(masked[F.col("t")]).alias("mask"))
    groups = hidden.groupBy("mask", F.col("fp").bitwiseAND(F.bitwise_not("mask")).alias("rest")).agg(F.collect_set("fp").alias("fps"))
    return pairs.union(groups.where("size(fps) > 1").select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b"))


def linked(docs: DataFrame, words: int = 3, max_distance: int = 2, blocks: int = 4, hot: int = 1024) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id among the documents that links reach."""
    prints = cut(fingerprints(docs, words).select("doc_id", F.col("fp")[0].alias("fp")))
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(close_pairs(firsts.select("fp"), max_distance, blocks, hot))
    of = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = of.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(of.join(smallest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


WIDTH, BLOCKS_A_WORD, BLOCK_BITS = 24, 3, 20
SKETCH_BITS, SKETCH_PART = 20, 4096
SKETCH = 1 << SKETCH_BITS


def distance(a: str, b: str):
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, WIDTH)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def angle_of(similarity: float) -> float:
    """The share of differing bits at a Jaccard coefficient, for sets of equal size; small sets of unequal size can differ in more."""
    return acos(2 * similarity / (1 + similarity)) / pi


def bound(bits: int, similarity: float, slack: float) -> int:
    angle = angle_of(similarity)
    return ceil(bits * angle + slack * sqrt(bits * angle * (1 - angle)))


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def scanned(keyed: DataFrame, words: int) -> DataFrame:
    """One pass over the texts: a row (doc_id, text_key, set_key, fp) for each, and rows (part, counts) that say how many shingles
    of the task's texts fall into each of SKETCH buckets by their hash. ``set_key`` names the set of distinct shingles."""
    kind = dict(keyed.dtypes)["doc_id"]
    ddl = f"doc_id {kind}, text_key string, set_key string, fp array<bigint>, part int, counts binary"

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SKETCH, np.int64)

        def rows():
            for batch in it:
                for doc_id, text_key, text in rows_of(batch, "doc_id", "text_key", "text"):
                    h = shingle_hashes(text, words)
                    np.add.at(total, bucket(h), 1)
                    h = np.unique(h)
                    yield doc_id, text_key, xxhash.xxh3_128_hexdigest(h.tobytes()), majority(h, WIDTH).view(np.int64), None, None
            yield from ((None, None, None, None, k, zlib.compress(c.tobytes(), 1)) for k, c in enumerate(total.reshape(-1, SKETCH_PART)) if c.any())

        yield from batches(rows(), ddl, 500)

    return keyed.mapInArrow(each, ddl)


def shingle_counts(found: DataFrame) -> np.ndarray:
    """The counts of ``scanned`` summed: a fixed number of counts, whatever the corpus."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(SKETCH_PART, np.int64))
        for batch in it:
            for part, counts in rows_of(batch, "part", "counts"):
                sums[part] += np.frombuffer(zlib.decompress(counts), np.int64)
        yield from batches(((k, c.tobytes()) for k, c in sums.items()), "part int, counts binary", 64)

    total = np.zeros((SKETCH // SKETCH_PART, SKETCH_PART), np.int64)
    for r in found.where("part IS NOT NULL").select("part", "counts").repartition("part").mapInArrow(each, "part int, counts binary").toLocalIterator():  # SKETCH numbers
        total[r["part"]] += np.frombuffer(r["counts"], np.int64)
    return np.minimum(total.reshape(-1), 2**31 - 1).astype(np.int32)


def prefixes(texts_of: DataFrame, words: int, similarity: float, counts: np.ndarray) -> DataFrame:
    """uid, n, pos, key: of each text's n distinct shingles, the rarest first, so many that two texts of the similarity share one."""
    ddl = "uid bigint, n int, keys array<bigint>"

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in it:
                for uid, text in rows_of(batch, "uid", "text"):
                    h = np.unique(shingle_hashes(text, words))
                    if len(h):
                        first = h[np.lexsort((h, counts[bucket(h)]))][: len(h) - ceil(similarity * len(h) - 1e-9) + 1]
                        yield uid, len(h), first.view(np.int64)

        yield from batches(rows(), ddl, 2000)

    return texts_of.mapInArrow(each, ddl).select("uid", "n", F.posexplode("keys").alias("pos", "key"))


def may_reach(similarity: float):
    """Whether the texts a and b can have the similarity if theirs is the first shingle shared: it and what follows must suffice."""
    rest = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    return rest >= similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-9


def side(keys: DataFrame, x: str, *more: str) -> DataFrame:
    return keys.select("key", F.col("uid").alias(x), F.col("n").alias(f"n{x}"), F.col("pos").alias(f"p{x}"), *more)


def shingle_sets(texts_of: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """uid and the sorted distinct shingle hashes of the texts in ``wanted`` (uid)."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches(((uid, np.unique(shingle_hashes(text, words)).view(np.int64)) for b in it for uid, text in rows_of(b, "uid", "text")), "uid bigint, shingles array<bigint>", 500)

    return texts_of.join(small(cut(wanted)), "uid", "left_semi").select("uid", "text").mapInArrow(each, "uid bigint, shingles array<bigint>")


def nodes_in(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("uid")).distinct()


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose shingle sets have the similarity."""
    set_a, set_b = (sets.select(F.col("uid").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    same = F.size(F.array_intersect("sa", "sb"))
    return cut(pairs.join(set_a, "a").join(set_b, "b").where(same >= similarity * (F.size("sa") + F.size("sb") - same)).select("a", "b"))


def block_leads(nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b) for each block and text b in it whose fingerprint is close to that of the block's first text a."""
    spread = [F.shiftrightunsigned(F.col("fp")[w], BLOCK_BITS * k).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).cast("int").bitwiseOR(F.lit(BLOCKS_A_WORD * w + k << BLOCK_BITS)) for w in range(WIDTH) for k in range(BLOCKS_A_WORD)]
    keys = shared(nodes.select("uid", F.col("fp")[0].alias("f0"), F.explode(F.array(*spread)).alias("key")))
    leads = keys.groupBy("key").agg(F.min(F.struct("uid", "f0")).alias("lead")).select("key", F.col("lead.uid").alias("a"), F.col("lead.f0").alias("fa"))
    rough = F.bit_count(F.col("f0").bitwiseXOR(F.col("fa"))) <= bound(64, similarity, 4.5)
    return keys.join(leads, "key").where((F.col("uid") != F.col("a")) & rough).select("a", F.col("uid").alias("b"))


def shared(rows: DataFrame) -> DataFrame:
    """The rows whose ``key`` another row has too: most keys have one row, and only counts are shuffled to see that."""
    return cut(rows.join(rows.groupBy("key").count().where(F.col("count") > 1).select("key"), "key"))


def with_roots(rows: DataFrame, roots: DataFrame, uid: str, root: str) -> DataFrame:
    """``rows`` with the component of ``uid``: its own number where it has no link."""
    return rows.join(roots.select(F.col("node").alias(uid), F.col("root").alias(root)), uid, "left").withColumn(root, F.coalesce(root, uid))


ROUGH_WORDS, ROUGH_SLACK, ROUGH_LEAST = 12, 4, 16


def may_be_close(similarity: float):
    """Whether the first words of the fingerprints (sa, sb) leave room for the similarity; small sets, whose bits say less, always may."""
    apart = sum((F.bit_count(F.col("sa")[i].bitwiseXOR(F.col("sb")[i])) for i in range(1, ROUGH_WORDS)), F.bit_count(F.col("sa")[0].bitwiseXOR(F.col("sb")[0])))
    return (F.least("na", "nb") < ROUGH_LEAST) | (apart <= bound(64 * ROUGH_WORDS, similarity, ROUGH_SLACK))


def across(many: DataFrame, roots: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of texts in different components that share a key and may have the similarity.

    One of each such pair is outside the key's largest component, so only those outside meet the others. Texts meet by bands of size, as sizes
    can't differ by more than the similarity. Positions, sizes and fingerprints are compared inside the join, so a passage that many unlike texts share gives no pairs.
    """
    ranked = with_roots(many.select("key", "uid", "n", "pos"), roots, "uid", "root")
    sizes = ranked.groupBy("key", "root").count()
    largest = sizes.groupBy("key").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("count", "root")).alias("largest")).where("roots > 1").select("key", "largest")
    sketch = nodes.select("uid", F.slice("fp", 1, ROUGH_WORDS).alias("s"))
    mixed = cut(ranked.join(largest, "key").join(sketch, "uid").withColumn("band", F.floor(F.log("n") / -log(similarity) + 1e-9)))
    here = side(mixed, "a", F.col("root").alias("ra"), "largest", "band", F.col("s").alias("sa"))
    few = mixed.where("root <> largest").select("*", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("near"))
    outside = side(few, "b", F.col("root").alias("rb"), F.col("near").alias("band"), F.col("s").alias("sb"))
    once = (F.col("ra") == F.col("largest")) | (F.col("a") < F.col("b"))
    same = ["key", "band"]
    met = here.alias("x").join(outside.alias("y"), [F.col(f"x.{c}") == F.col(f"y.{c}") for c in same] + [F.col("ra") != F.col("rb"), once, may_reach(similarity), may_be_close(similarity)])
    return met.select("a", "b").distinct()


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``near_duplicate_rows``, found step by step: each step is kept in the shared folder, so its shuffles go at once."""
    with shuffles_go(docs.sparkSession):
        return near_duplicate_rows(docs, words, similarity)


def near_duplicate_rows(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, text_key (SHA-256 of the text), component (any number), keep.

    ``keep`` marks one row of each component: that with the smallest doc_id, null ids last.
    """
    keyed = texts(docs, "doc_id").withColumn("text_key", F.sha2("text", 256))
    found = cut(scanned(keyed, words))
    counts = shingle_counts(found)
    nodes = cut(found.where("part IS NULL").groupBy("set_key").agg(F.min("text_key").alias("text_key"), F.first("fp").alias("fp")).withColumn("uid", F.monotonically_increasing_id()))
    once = keyed.groupBy("text_key").agg(F.first("text").alias("text"))
    texts_of, texts_path = kept(once.join(nodes.select("text_key", "uid"), "text_key").select("uid", "text"), "near-duplicate-texts")

    rare, rare_path = kept(prefixes(texts_of, words, similarity, counts), "prefixes")
    many = shared(rare)
    remove(docs.sparkSession, rare_path)
    # The lead is the text with the fewest rarer shingles: of a group of near copies, the one with the fewest edits of its own.
    leads = many.groupBy("key").agg(F.min(F.struct("pos", "uid", "n")).alias("lead")).select("key", F.col("lead.uid").alias("a"), F.col("lead.n").alias("na"), F.col("lead.pos").alias("pa"))
    led = side(many, "b").join(leads, "key").where((F.col("a") != F.col("b")) & may_reach(similarity)).select("a", "b").groupBy("a", "b").agg(F.count("*").alias("m"))
    blocks = block_leads(nodes, similarity).groupBy("a", "b").agg(F.count("*").alias("m"))
    fp_a, fp_b = (nodes.select(F.col("uid").alias(x), F.col("fp").alias(f"f{x}")) for x in "ab")
    close = blocks.join(fp_a, "a").join(fp_b, "b").where(distance("fa", "fb") <= bound(64 * WIDTH, similarity, 3)).select("a", "b", "m")
    candidates = cut(led.union(close).groupBy("a", "b").agg(F.sum("m").alias("m")))
    sets = written(shingle_sets(texts_of, nodes_in(candidates), words), "shingles")

    # Each text is held against its likeliest lead first; leads in the component that it then has need no comparison.
    likeliest = candidates.groupBy("b").agg(F.max_by("a", F.struct("m", "a")).alias("a")).select("a", "b")
    links = alike(likeliest, sets, similarity)
    roots = cut(components(links))
    others = with_roots(with_roots(candidates.join(likeliest, ["a", "b"], "left_anti"), roots, "a", "ra"), roots, "b", "rb").where("ra <> rb").select("a", "b")
    links = links.union(alike(others, sets, similarity))
    roots = cut(components(links))
    rest = cut(across(many, roots, nodes, similarity))
    links = links.union(alike(rest, written(shingle_sets(texts_of, nodes_in(rest), words), "shingles"), similarity))
    remove(docs.sparkSession, texts_path)
    final = cut(components(links))

    ids = found.where("part IS NULL").groupBy("text_key", "doc_id", "set_key").count().drop("count")
    rows = with_roots(ids.join(nodes.select("set_key", "uid"), "set_key"), final, "uid", "component")
    rank = F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")
    best = rows.groupBy("component").agg(F.min(rank).alias("best"))
    return rows.join(best, "component").select("doc_id", "text_key", "component", F.expr("doc_id <=> best.doc_id AND text_key = best.text_key").alias("keep"))


def row_key(doc_id: str, text_key: str):
    """One string for an id, or none, and a text: a null-free key that a join and a window after it can share."""
    return F.concat(F.col(text_key), F.coalesce(F.concat(F.lit(":"), F.col(doc_id).cast("string")), F.lit("")))


def deduplicated(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs``, with one row of each group of near-duplicates; its columns are unchanged. Of rows with the same id and text, one by a hash."""
    chosen = near_duplicates(docs, words, similarity).where("keep").select(row_key("doc_id", "text_key").alias("__key"))
    dealt = docs.withColumn("__text_key", F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn("__key", row_key("doc_id", "__text_key"))
    once = F.row_number().over(Window.partitionBy("__key").orderBy(F.xxhash64(*docs.columns)))
    return dealt.join(chosen, "__key").withColumn("__n", once).where("__n = 1").select(*docs.columns)
