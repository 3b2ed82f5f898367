"""Quality by a character model: interpolated modified Kneser-Ney n-grams of trusted text.

The vocabulary is the characters themselves, of any script (white space as one, digits as one, capitals as one; beyond the basic plane
one for each 4,096), 16 bits each, so an n-gram of order 4 is one 64-bit number. Tasks count the n-grams of trusted texts; the counts are summed and
sharded by n-gram, continuation counts follow from the distinct n-grams of the order above, and joins of the shards (an n-gram with its
context's totals, and with the probability of its shorter form) give every seen n-gram its interpolated probability and every context its
back-off weight. The distinct n-grams of all documents are joined to these shards, order by order, for their log probabilities. Where
these are at most ``most_broadcast`` (checked; 16 bytes each) the tasks that read the documents get them whole; beyond that each document's n-gram
counts are joined to them. Both give the same perplexities.

A document is kept if its perplexity is at most the quantile of its language among trusted documents that the model wasn't
trained on; a language without any uses the quantile over all. Null languages are a language. Null and empty texts have no
perplexity and aren't kept. Without trusted text all are kept. Rows are independent, so repeated rows and ids are each judged; ties with
the threshold are kept; very long texts are read whole; only doc_id, lang and text are read, so other columns can't clash; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import batches, cut, rows_of, small, texts, type_of, written

ORDER, BITS = 4, 16
START, CAPITAL, DIGIT, SPACE, ASTRAL = 1, 0x41, 0x30, 0x20, 0xE000
HELD = 2_000_000


class Folding(dict):
    """A str.translate table that works out each character once."""

    def __missing__(self, code: int) -> int:
        c = chr(code)
        out = SPACE if c.isspace() else DIGIT if c.isdigit() else CAPITAL if c.isupper() else ASTRAL + (code >> 12) if code > 0xFFFF else code
        self[code] = out
        return out


FOLDING = Folding()


def grams(text: str) -> np.ndarray:
    """The n-gram that ends at each character, as a 64-bit number; the last character is in the lowest bits."""
    codes = np.frombuffer((chr(START) * (ORDER - 1) + text.translate(FOLDING)).encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint64)
    n = len(codes) - ORDER + 1
    out = np.zeros(n, np.uint64)
    for k in range(ORDER):
        out = (out << np.uint64(BITS)) | codes[k : k + n]
    return out.view(np.int64)


def counted(docs: DataFrame) -> DataFrame:
    """gram, n: how often each n-gram occurs in the texts."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush():
            found, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n.astype(np.int64))], names=["gram", "n"])

        for batch in it:
            for (text,) in rows_of(batch, "text"):
                held.append(grams(text))
                size += len(held[-1])
                if size > HELD:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return docs.select("text").mapInArrow(each, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> list[float]:
    """Chen and Goodman's three discounts from the counts of counts; a half of each count's share where those are missing."""
    r = counts.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in range(1, 5)]).first()
    n = [0, *r]
    if not n[1] or not n[2]:
        return [0.5, 0.75, 1.0]
    y = n[1] / (n[1] + 2 * n[2])
    raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k for k in range(1, 4)]
    return [min(max(d, 0.05), k * 0.95) for k, d in zip(range(1, 4), raw, strict=True)]


def last(gram: str, k: int):
    """The n-gram's last ``k`` characters."""
    return F.col(gram) if k == ORDER else F.col(gram).bitwiseAND(F.lit((1 << BITS * k) - 1))


def context(gram: str):
    return F.shiftrightunsigned(gram, BITS)


class Model:
    """For each order from 1 the tables (gram, p) of seen n-grams and (context, weight), and the share of an unseen character."""

    def __init__(self, counts: DataFrame):
        levels = [cut(counts)]
        for k in range(ORDER - 1, 0, -1):
            levels.append(cut(levels[-1].groupBy(last("gram", k).alias("gram")).agg(F.count("*").alias("n"))))
        self.size = levels[-1].count()
        self.tables: list[tuple[DataFrame, DataFrame]] = []
        for k, level in enumerate(reversed(levels), 1):
            d1, d2, d3 = discounts(level)
            split = level.withColumn("context", context("gram")).withColumn("discount", F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3))
            totals = split.groupBy("context").agg(F.sum("n").alias("total"), (F.sum("discount") / F.sum("n")).alias("weight"))
            joined = split.join(totals, "context")
            if k == 1:
                lower = F.lit(1 / (self.size + 1))  # one more for a character never seen
            else:
                joined = joined.withColumn("suffix", last("gram", k - 1)).join(self.tables[-1][0].select(F.col("gram").alias("suffix"), F.col("p").alias("p_lower")), "suffix")
                lower = F.col("p_lower")
            self.tables.append((cut(joined.select("gram", ((F.col("n") - F.col("discount")) / F.col("total") + F.col("weight") * lower).alias("p"))), totals.select("context", "weight")))

    def log_p(self, asked: DataFrame) -> DataFrame:
        """gram, log_p of the n-grams in ``asked``: joined to the shards of each order."""
        weight = self.tables[0][1].first()["weight"]  # one context
        found = asked.select("gram", F.lit(weight / (self.size + 1)).alias("below"))
        for k, (seen, weights) in enumerate(self.tables, 1):
            found = found.withColumn("g", last("gram", k)).join(seen.select(F.col("gram").alias("g"), "p"), "g", "left")
            if k > 1:
                found = found.withColumn("context", context("g")).join(weights, "context", "left").withColumn("below", F.coalesce("weight", F.lit(1.0)) * F.col("below"))
            found = found.select("gram", F.coalesce("p", "below").alias("below"))
        return found.select("gram", F.log("below").alias("log_p"))


def train(trusted: DataFrame) -> Model | None:
    """A model of the texts, None if there are none."""
    counts = cut(counted(trusted))
    return Model(counts) if counts.limit(1).count() else None


def perplexities(docs: DataFrame, model: Model | None, most_broadcast: int = 3_000_000) -> DataFrame:
    """doc_id, lang, perplexity (by character; null for empty texts and without a model)."""
    rows = texts(docs, "doc_id", "lang")
    if model is None:
        return rows.select("doc_id", "lang", F.lit(None).cast("double").alias("perplexity"))
    known = cut(model.log_p(cut(counted(rows).select("gram"))))  # read by several joins
    if known.count() > most_broadcast:
        return joined_perplexities(rows, known)
    table = known.toPandas().sort_values("gram")  # checked above
    shared = docs.sparkSession.sparkContext.broadcast((table["gram"].to_numpy(np.int64), table["log_p"].to_numpy(np.float64)))
    ddl = f"doc_id {type_of(docs, 'doc_id')}, lang string, perplexity double"

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, log_p = shared.value

        def rows_():
            for batch in it:
                for doc_id, lang, text in rows_of(batch, "doc_id", "lang", "text"):
                    yield doc_id, lang, float(np.exp(-log_p[np.searchsorted(seen, grams(text))].mean())) if text else None

        yield from batches(rows_(), ddl)

    return rows.mapInArrow(each, ddl)


def joined_perplexities(rows: DataFrame, known: DataFrame) -> DataFrame:
    """The same by a join of each text's n-gram counts with the n-grams' log probabilities."""
    keyed = cut(rows.withColumn("uid", F.monotonically_increasing_id()))

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for uid, text in rows_of(batch, "uid", "text"):
                found, n = np.unique(grams(text), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), uid, np.int64)), pa.array(found), pa.array(n.astype(np.int64))], names=["uid", "gram", "n"])

    sums = keyed.select("uid", "text").mapInArrow(each, "uid bigint, gram bigint, n bigint").join(known, "gram").groupBy("uid").agg(F.exp(-F.sum(F.col("n") * F.col("log_p")) / F.sum("n")).alias("perplexity"))
    return keyed.select("uid", "doc_id", "lang").join(sums, "uid", "left").select("doc_id", "lang", "perplexity")


def judged(docs: DataFrame, trusted_ids: DataFrame, quantile: float = 0.99, held_out: int = 5, **options) -> DataFrame:
    """doc_id, lang, perplexity, threshold, keep. ``trusted_ids``: doc_id of trusted documents, one in ``held_out`` of which sets the thresholds."""
    ids = trusted_ids.select(F.col("doc_id").alias("trusted_id")).distinct().withColumn("fold", F.pmod(F.xxhash64("trusted_id"), F.lit(held_out)))
    train_ids, test_ids = ids.where("fold > 0"), ids.where("fold = 0")
    model = train(texts(docs, "doc_id").join(small(train_ids), F.col("doc_id") == F.col("trusted_id")).select("text"))
    scored = written(perplexities(docs, model, **options), "perplexity")
    known = scored.join(test_ids, F.col("doc_id") == F.col("trusted_id")).where("perplexity IS NOT NULL")
    at = F.percentile_approx("perplexity", quantile, 10_000)
    by_lang = known.groupBy("lang").agg(at.alias("lang_threshold")).select(F.col("lang").alias("of"), "lang_threshold")
    overall = known.agg(at.alias("overall"))
    judged_ = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("of")), "left").crossJoin(F.broadcast(overall))  # one row
    threshold = F.coalesce("lang_threshold", "overall")
    keep = F.when(F.lit(model is None), True).otherwise(F.col("perplexity").isNotNull() & (threshold.isNull() | (F.col("perplexity") <= threshold)))
    return judged_.select("doc_id", "lang", "perplexity", threshold.alias("threshold"), keep.alias("keep"))
