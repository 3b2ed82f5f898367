"""Document fingerprints as invertible Bloom lookup sketches, in DataFrame and SQL functions alone.

A text's paragraphs (runs between line breaks, sentence ends, semicolons and bars, trimmed) are hashed to 64-bit
digests, each once. A sketch has three tables of cells; a digest goes into one cell of each, and a cell holds how many
digests it has, their exclusive or, and that of a checksum of each. The fingerprint is the text's sketch of 12 cells in hex.

To compare two versions their sketches are subtracted cell by cell, which cancels what they share, and peeled: a
cell with a count of one and a fitting checksum gives up a digest, which then leaves its other cells. If cells remain,
the comparison is retried larger: digests are dealt into groups of 7 to 14 on average by their upper bits, with a sketch of
24 cells for each, and a group that still doesn't peel gets 48, 192 and 1,536 cells. The digests recovered on
either side give the Jaccard coefficient of the two paragraph sets: the likeness. Two texts without paragraphs are alike.

``versions`` pairs each document with the next one in descending order of doc_id (null ids last, equal ids by text;
after the last: the first). Documents are dealt into ranges of ids by approximate quantiles, each with a copy of the first
document of the next range, so one shuffle by range and a window inside the range do; nothing is ordered globally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.llm.common import texts, type_of

BREAK = r"\\n|(?<=[.!?;|])\\s+"
RANGE_ROWS = 500
MOST_RANGES = 65_536
SAMPLED = 16
SMALL, GROUP, LARGER = 4, 14, (8, 16, 64, 512)
SHIFTS = (8, 20, 32)
GROUP_SHIFT = 44


def digests(text: str) -> str:
    """SQL for the distinct digests of a text column's paragraphs."""
    return f"array_distinct(transform(filter(transform(split({text}, '{BREAK}'), p -> trim(p)), p -> p <> ''), p -> xxhash64(p)))"


ZERO = "named_struct('c', 0, 'k', 0L, 'h', 0)"


def table(signed: str, j: int, w: int) -> str:
    """SQL for one of a sketch's three tables: ``signed`` is an array of (d: digest, s: 1 or -1)."""
    at = f"shiftright(x.d, {SHIFTS[j]}) & {w - 1}"
    return f"transform(sequence(0, {w - 1}), i -> aggregate(filter({signed}, x -> ({at}) = i), {ZERO}, (a, x) -> named_struct('c', a.c + x.s, 'k', a.k ^ x.d, 'h', a.h ^ hash(x.d))))"


def sketch(signed: str, w: int) -> str:
    return f"named_struct('t0', {table(signed, 0, w)}, 't1', {table(signed, 1, w)}, 't2', {table(signed, 2, w)})"


def signed(array: str, s: int) -> str:
    return f"transform({array}, d -> named_struct('d', d, 's', {s}))"


def subtracted(a: str, b: str) -> str:
    part = "named_struct('c', x.c - y.c, 'k', x.k ^ y.k, 'h', x.h ^ y.h)"
    return "named_struct(" + ", ".join(f"'t{j}', zip_with({a}.t{j}, {b}.t{j}, (x, y) -> {part})" for j in range(3)) + ")"


def peeled(cells: str, w: int, rounds: int) -> str:
    """SQL for (plus, minus): how many digests only the first or only the second version has; null if cells remain."""
    left = ", ".join(f"transform(st.t{j}, (x, i) -> aggregate(filter(pure, p -> (shiftright(p.k, {SHIFTS[j]}) & {w - 1}) = i), x, (a, p) -> named_struct('c', a.c - p.c, 'k', a.k ^ p.k, 'h', a.h ^ p.h))) AS t{j}" for j in range(3))
    pure = "array_distinct(filter(concat(st.t0, st.t1, st.t2), x -> abs(x.c) = 1 AND hash(x.k) = x.h))"
    after = f"struct({left}, st.plus + size(filter(pure, p -> p.c = 1)) AS plus, st.minus + size(filter(pure, p -> p.c = -1)) AS minus, true AS more)"
    over = "struct(st.t0 AS t0, st.t1 AS t1, st.t2 AS t2, st.plus AS plus, st.minus AS minus, false AS more)"
    step = f"if(st.more, element_at(transform(array({pure}), pure -> if(size(pure) = 0, {over}, {after})), 1), st)"
    start = f"element_at(transform(array({cells}), s -> struct(s.t0 AS t0, s.t1 AS t1, s.t2 AS t2, 0 AS plus, 0 AS minus, true AS more)), 1)"
    done = "forall(concat(e.t0, e.t1, e.t2), x -> x.c = 0 AND x.k = 0 AND x.h = 0)"
    return f"aggregate(sequence(1, {rounds}), {start}, (st, r) -> {step}, e -> if({done}, struct(e.plus AS plus, e.minus AS minus), null))"


def grouped(both: str, n: str) -> str:
    """SQL for the groups of an array of signed digests, about ``GROUP`` in each: dealt in two steps, so long texts stay cheap."""
    bits = f"cast(greatest(0, ceil(log2(greatest({n}, 1) / {GROUP}D))) AS int)"
    return (
        f"element_at(transform(array(named_struct('hi', {bits} div 2, 'lo', {bits} - {bits} div 2)), b -> flatten(transform(sequence(0, cast(shiftleft(1, cast(b.hi AS int)) - 1 AS int)), g -> "
        f"element_at(transform(array(filter({both}, x -> (shiftright(x.d, {GROUP_SHIFT}) & (shiftleft(1, cast(b.hi AS int)) - 1)) = g)), part -> "
        f"transform(sequence(0, cast(shiftleft(1, cast(b.lo AS int)) - 1 AS int)), l -> filter(part, x -> (shiftright(x.d, {GROUP_SHIFT} + cast(b.hi AS int)) & (shiftleft(1, cast(b.lo AS int)) - 1)) = l))), 1)))), 1)"
    )


def differing(small_a: str, small_b: str, a: str, b: str) -> str:
    """SQL for (plus, minus) between two versions: from their fingerprints' sketches, else retried larger."""
    one = ", ".join(peeled(sketch("g", w), w, rounds) for w, rounds in zip(LARGER, (10, 14, 20, 30), strict=True))
    both = f"concat({signed(a, 1)}, {signed(b, -1)})"
    total = "aggregate(q, named_struct('plus', 0, 'minus', 0), (t, x) -> named_struct('plus', t.plus + x.plus, 'minus', t.minus + x.minus))"
    larger = f"element_at(transform(array(transform({grouped(both, f'size({a}) + size({b})')}, g -> coalesce({one}))), q -> {total}), 1)"
    return f"coalesce({peeled(subtracted(small_a, small_b), SMALL, 8)}, {larger})"


def likeness(small_a: str, small_b: str, a: str, b: str) -> str:
    d = differing(small_a, small_b, a, b)
    return f"element_at(transform(array({d}), d -> if(size({a}) + d.minus = 0, 1D, (size({a}) - d.plus) / cast(size({a}) + d.minus AS double))), 1)"


def printed(cells: str) -> str:
    return f"array_join(transform(concat({cells}.t0, {cells}.t1, {cells}.t2), x -> concat(lpad(lower(hex(x.c)), 6, '0'), lpad(lower(hex(x.k)), 16, '0'), lpad(right(lower(hex(x.h)), 8), 8, '0'))), '')"


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, text, digests, cells, fingerprint of every row."""
    parts = texts(docs, "doc_id").withColumn("digests", F.expr(digests("text")))
    return parts.withColumn("cells", F.expr(sketch(signed("digests", 1), SMALL))).withColumn("fingerprint", F.expr(printed("cells")))


def range_of(bounds: list, doc_id: str, kind: str):
    """The number of bounds that an id exceeds, by binary search; -1 for null."""
    steps = max(1, len(bounds).bit_length())
    table_ = F.array(*[F.lit(b).cast(kind) for b in bounds]) if bounds else F.array().cast(f"array<{kind}>")

    def step(low, k):
        to = low + F.pow(F.lit(2.0), F.lit(steps - 1) - k).cast("int")
        return F.when((to <= len(bounds)) & (F.get(table_, to - 1) < F.col(doc_id)), to).otherwise(low)

    return F.when(F.col(doc_id).isNull(), -1).otherwise(F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.lit(0), step))


def bounds_of(ids: DataFrame, kind: str) -> list:
    """Ids that split the table into ranges of about ``RANGE_ROWS`` rows: approximate quantiles of integers; of other types, those of a sample by hash."""
    n = ids.count()
    ranges = min(MOST_RANGES, -(-n // RANGE_ROWS))
    if ranges < 2:
        return []
    if kind in ("bigint", "int", "smallint", "tinyint"):
        return sorted({int(b) for b in ids.approxQuantile("doc_id", [k / ranges for k in range(1, ranges)], 0.2 / ranges)})
    every = max(1, n // (SAMPLED * ranges))
    sample = sorted(r[0] for r in ids.where("doc_id IS NOT NULL").distinct().where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).collect())  # about SAMPLED * MOST_RANGES at most
    return sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if sample else []


def versions(docs: DataFrame) -> DataFrame:
    """The rows of ``fingerprint`` with those of the next document: next_text, next_digests, next_cells. Also range, n."""
    kind = type_of(docs, "doc_id")
    bounds = bounds_of(docs.select("doc_id"), kind)
    dealt = texts(docs, "doc_id").withColumn("range", range_of(bounds, "doc_id", kind))
    tops = {r["range"]: r["top"] for r in dealt.groupBy("range").agg(F.max("doc_id").alias("top")).collect()}  # at most MOST_RANGES rows
    order = sorted(tops, reverse=True)
    after = zip(order, [*order[1:], *order[:1]], strict=True)
    head = docs.sparkSession.createDataFrame([(at, tops[then]) for at, then in after], f"to int, top {kind}")
    firsts = dealt.join(F.broadcast(head), F.col("doc_id").eqNullSafe(F.col("top"))).groupBy("to", "doc_id").agg(F.min("text").alias("text"))
    rows = dealt.select("range", "doc_id", "text", F.lit(0).alias("ghost")).unionByName(firsts.select(F.col("to").alias("range"), "doc_id", "text", F.lit(1).alias("ghost")))
    w = Window.partitionBy("range").orderBy("ghost", F.desc_nulls_last("doc_id"), "text")
    parts = rows.repartition("range").withColumn("digests", F.expr(digests("text")))
    paired = parts.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in ("text", "digests")]).where("ghost = 0")
    return paired.drop("ghost")


def compared(docs: DataFrame) -> DataFrame:
    """Each document with its edited text: the last third of its code points replaced by the next document's first as many.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    base = versions(docs).withColumn("n_chars", F.length("text").cast("bigint"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - third), F.substr("next_text", F.lit(1), third))
    with_edited = base.withColumn("edited", edited).withColumn("edited_digests", F.expr(digests("edited"))).withColumn("edited_sha256", F.sha2("edited", 256))
    cells = {x: F.expr(sketch(signed(f"{x}digests", 1), SMALL)).alias(f"{x}cells") for x in ("", "edited_", "next_")}
    sketched = with_edited.select("doc_id", "n_chars", "edited_sha256", "digests", "edited_digests", "next_digests", *cells.values())
    return sketched.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.expr(printed("cells")).alias("fingerprint"),
        F.expr(printed("edited_cells")).alias("edited_fingerprint"),
        F.expr(likeness("cells", "edited_cells", "digests", "edited_digests")).alias("near_edited"),
        F.expr(likeness("cells", "next_cells", "digests", "next_digests")).alias("near_next"),
    )
