"""Toxicity by a weighted lexicon.

Texts are folded first: compatibility forms and accents go, look-alike letters of other scripts and digits or signs that
stand for letters become Latin letters (i, l and 1 are one letter), invisible characters go, and whatever isn't a letter then
separates words. The lexicon holds folded words and word beginnings with a weight. All of a text's hits are
found in one pass of an Aho-Corasick automaton; a hit inside an exception phrase doesn't count. The sum of weights, as it
stands and per word of the text, goes through a logistic curve to a score between 0 and 1.

``fit`` learns lexicon, exceptions and curve from labelled rows: a sample of at most ``most_rows``, by hash of the id,
without repeated texts. An entry needs ``support`` of the toxic texts and ``precision`` among the texts that have it; the
shortest beginning that reaches both stands for all longer ones. An exception is an entry with the word before
or after it that clean texts use and toxic ones hardly do; a word that reaches the precision only outside exceptions joins. All that reach these bounds are
in: as an entry needs its share of the toxic texts, their number follows the words of a text, not the corpus.

Null and empty texts score as texts without hits. Without labels of both kinds, or without documents, the lexicon is empty and every
score is the same. A text with both labels counts as toxic; of entries that start at one place the weightiest counts. Rows are scored one by one,
whole however long; repeated rows get equal scores. Only doc_id and text are read, so other columns can't clash.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil, exp, log, log1p

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import batches, cut, rows_of, texts, type_of, written

# Letters that look like Latin ones, and digits and signs used for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ı": "i", "ɑ": "a", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "£": "l"}
INVISIBLE = "­​‌‍⁠﻿"


class Folding(dict):
    """A str.translate table that works out each character once."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in INVISIBLE:
            out = ""
        else:
            out = "".join(" " if not x.isascii() or not x.isalpha() else "i" if x == "l" else x for low in unicodedata.normalize("NFKD", c).lower() if not unicodedata.combining(low) for x in LOOKALIKES.get(low, DIGITS.get(low, low)))
        self[code] = out
        return out


FOLDING = Folding()


def folded(text: str) -> str:
    """Words of a-z, each between single spaces, with a space at either end."""
    return f" {' '.join(text.translate(FOLDING).split())} "


LONGEST_START, SHORTEST_START = 8, 4


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)  # " word " or " beginning"
    exceptions: list[str] = field(default_factory=list)  # " word word "
    curve: tuple[float, float, float] = (-2.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(phrase, (phrase, None))
        for entry, weight in self.weights.items():
            found.add_word(entry, (entry, weight))
        found.make_automaton()
        return found


def hits(machine: ahocorasick.Automaton, text: str) -> list[tuple[int, str, float]]:
    """(place, entry, weight) of the hits that count in a folded text; of entries that start at one place, the weightiest."""
    best, spared = {}, []
    for end, (entry, weight) in machine.iter(text):
        start = end - len(entry) + 1
        if weight is None:
            spared.append((start, end))
        elif start not in best or weight > best[start][1]:
            best[start] = (entry, weight)
    return [(at, *x) for at, x in sorted(best.items()) if not any(a <= at and at + len(x[0].strip()) <= b for a, b in spared)]


def features(machine: ahocorasick.Automaton | None, text: str) -> tuple[float, float, int]:
    """Sum of weights, that per 100 words, and the number of hits."""
    text = folded(text)
    found = hits(machine, text) if machine and len(text) > 2 else []
    total = sum(x[2] for x in found)
    return total, 100 * total / max(1, text.count(" ") - 1), len(found)


def scored(curve: tuple[float, float, float], total: float, density: float) -> float:
    z = curve[0] + curve[1] * log1p(total) + curve[2] * log1p(density)
    return 1 / (1 + exp(-z)) if z > -700 else 0.0


def grams(text: str) -> set[str]:
    words = set(folded(text).split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in range(SHORTEST_START, min(LONGEST_START, len(w) - 1) + 1)}


MOST_HELD = 50_000


def tally(rows: DataFrame, keys_of) -> DataFrame:
    """gram, toxic, clean: in how many texts of either kind; counted in the tasks first."""
    ddl = "gram string, toxic bigint, clean bigint"

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {0: Counter(), 1: Counter()}

        def flush():
            out = [(g, counts[1][g], counts[0][g]) for g in counts[0].keys() | counts[1].keys()]
            for c in counts.values():
                c.clear()
            yield from batches(out, ddl, 20_000)

        for batch in it:
            for toxic, text in rows_of(batch, "toxic", "text"):
                counts[toxic].update(keys_of(text))
                if len(counts[0]) + len(counts[1]) > MOST_HELD:
                    yield from flush()
        yield from flush()

    return rows.select("toxic", "text").mapInArrow(each, ddl).groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def training(docs: DataFrame, labels: DataFrame, most_rows: int) -> DataFrame:
    """toxic (int), text: the labelled rows, or a sample by hash if there are more than ``most_rows``; each text once."""
    chosen = labels.where("toxic IN (0, 1)").select(F.col("doc_id").alias("label_id"), F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("label_id"), "label_id", "toxic").limit(most_rows)
    joined = texts(docs, "doc_id").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id"))  # bounded by most_rows
    return joined.groupBy("text").agg(F.max("toxic").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 40_000, support: float = 0.02, least: int = 4, precision: float = 0.97, most_curve_rows: int = 20_000) -> Lexicon:
    rows = written(training(docs, labels, most_rows), "toxicity-training")
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return Lexicon()
    need = max(least, support * n[1])
    counts = cut(tally(rows, grams).where(F.col("toxic") >= need))
    weights = entries(counts, n, precision)
    if weights:  # then what explains the toxic texts that are left
        left = unhit(rows, Lexicon(weights))
        toxic_left = left.where("toxic = 1").count()
        weights |= entries(tally(left, grams).where(F.col("toxic") >= max(least, 5 * support * toxic_left)), n, precision)
    doubtful = {g: w for g, w in entries(counts, n, 0.7, " ").items() if not any(g[:k] in weights for k in range(SHORTEST_START + 1, len(g) + 1))}
    spared = exceptions(rows, Lexicon(weights | doubtful), n, least)
    if doubtful and spared:
        weights |= outside(rows, Lexicon(doubtful, spared), n, need, precision)
    if not weights:
        return Lexicon()
    top = max(weights.values())
    lexicon = Lexicon({g: w / top for g, w in weights.items()}, spared)
    lexicon.curve = curve(rows, lexicon, n[0] + n[1], most_curve_rows)
    return lexicon


def entries(counts: DataFrame, n: dict[int, int], precision: float, end: str = "") -> dict[str, float]:
    """The shortest of the counted grams (with ``end``) that ``precision`` of the texts that have them speaks for: log odds of each."""
    kept = counts.where(F.col("toxic") >= precision * (F.col("toxic") + F.col("clean")))
    weights: dict[str, float] = {}
    found = kept.where(F.col("gram").endswith(end)).collect()  # each in a share of the toxic texts
    for r in sorted(found, key=lambda r: (len(r["gram"].strip()), r["gram"])):
        gram = r["gram"]
        if not any(gram[:k] in weights for k in range(SHORTEST_START + 1, len(gram.rstrip()) + 1)):
            weights[gram] = max(0.1, log((r["toxic"] + 0.5) / (n[1] + 1)) - log((r["clean"] + 0.5) / (n[0] + 1)))
    return weights


def outside(rows: DataFrame, lexicon: Lexicon, n: dict[int, int], need: float, precision: float) -> dict[str, float]:
    """Of a lexicon's entries those that reach the precision once hits inside its exceptions don't count."""
    held = []

    def found(text: str) -> set[str]:
        if not held:  # once in a task
            held.append(lexicon.automaton())
        return {entry for _, entry, _ in hits(held[0], folded(text))}

    kept = tally(rows, found).where((F.col("toxic") >= need) & (F.col("toxic") >= precision * (F.col("toxic") + F.col("clean"))))
    return {r["gram"]: max(0.1, log((r["toxic"] + 0.5) / (n[1] + 1)) - log((r["clean"] + 0.5) / (n[0] + 1))) for r in kept.collect()}  # no more than the lexicon has


def unhit(rows: DataFrame, lexicon: Lexicon) -> DataFrame:
    """The toxic rows without a hit, and all clean ones."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton()
        for batch in it:
            keep = [not toxic or not hits(machine, folded(text)) for toxic, text in rows_of(batch, "toxic", "text")]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(each, rows.schema)


def exceptions(rows: DataFrame, lexicon: Lexicon, n: dict[int, int], least: int) -> list[str]:
    """Two-word phrases with a lexicon entry that at least ``least`` clean texts have and that speak against toxicity."""
    if not lexicon.weights:
        return []

    held = []

    def phrases(text: str) -> set[str]:
        if not held:  # once in a task
            held.append(lexicon.automaton())
        text, out = folded(text), set()
        for at, entry, _ in hits(held[0], text):
            end = text.index(" ", at + len(entry.strip()))
            before, after = text.rfind(" ", 0, at), text.find(" ", end + 1)
            out |= {text[before : end + 1]} if before >= 0 else set()
            out |= {text[at : after + 1]} if after >= 0 else set()
        return out

    met = tally(rows, phrases)
    rate = (F.col("toxic") / n[1]) / (F.col("clean") / n[0])
    return [r["gram"] for r in met.where((F.col("clean") >= least) & (rate < 0.5)).orderBy("gram").collect()]  # of the sample's words next to entries


def curve(rows: DataFrame, lexicon: Lexicon, n: int, most: int) -> tuple[float, float, float]:
    """A logistic regression with a light penalty on the two features, fitted on about ``most`` of the ``n`` rows: those with the least hashes."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton() if lexicon.weights else None
        yield from batches(((toxic, *features(machine, text)[:2]) for b in it for toxic, text in rows_of(b, "toxic", "text")), "toxic int, total double, density double")

    share = min(1.0, most / n)
    chosen = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < ceil(share * (1 << 20)))
    sample = chosen.select("toxic", "text").mapInArrow(each, "toxic int, total double, density double").toPandas().sort_values(["toxic", "total", "density"])  # numbers alone
    y = sample["toxic"].to_numpy(float)
    x = np.column_stack([np.ones(len(y)), np.log1p(sample["total"]), np.log1p(sample["density"])])
    b, penalty = np.zeros(3), np.diag([1e-6, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + penalty, x.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in b)


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted (1 from ``threshold`` on), n_hits, density (weight per 100 words)."""
    ddl = f"doc_id {type_of(docs, 'doc_id')}, score double, predicted int, n_hits bigint, density double"

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton() if lexicon.weights else None

        def rows():
            for batch in it:
                for doc_id, text in rows_of(batch, "doc_id", "text"):
                    total, density, n = features(machine, text)
                    s = scored(lexicon.curve, total, density)
                    yield doc_id, s, int(s >= threshold), n, density

        yield from batches(rows(), ddl)

    return texts(docs, "doc_id").mapInArrow(each, ddl)


def remainder(doc_id: str = "doc_id"):
    """crc32 of the id as text, mod 4; of a null id as of an empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4


def accepted(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the texts that reach the threshold; columns unchanged."""
    at, schema = docs.columns.index("text"), docs.schema

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = lexicon.automaton() if lexicon.weights else None
        for batch in it:
            keep = [scored(lexicon.curve, *features(machine, t or "")[:2]) < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(each, schema)
