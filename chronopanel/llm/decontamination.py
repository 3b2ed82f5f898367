"""Benchmark decontamination by templates.

Texts become templates: a number, in digits or in English words ("five", "twenty-five", "two hundred": in slots equal to the digits), turns into a number slot, a unit of measure after a number into a unit slot, a run of
capitalised words (wherever they stand, so a name at the start of a sentence is one too) into one name slot; other words
stay, in lower case, and punctuation goes. Windows of consecutive template tokens are hashed and the corpus's windows
are joined to the benchmark's. The windows of a document and an item that match at the same shift, or within a band of
``slack`` neighbouring shifts (a word put in or left out moves all that follows), are counted, and the slot values there
are compared: the item's values must map to the document's as a function (the same number must become the same number
everywhere). So a question with other numbers and names is found, and a text that only shares a form isn't.

A pair of document and item is reported where matching windows make up ``coverage`` of the item's windows at the best
shift or band, and the slots map consistently, or the windows with unchanged slots alone make up that share. A window of
mostly slots (fewer than ``literals`` words) says little by its form, so it counts only with its values unchanged. An item
shorter than a window is one window of its own length, which counts only with its values unchanged; one of fewer than
``shortest`` tokens, a word or two that any text may have, is found only in a text that consists of it.

The tasks drop windows that can't match by a bitmap of the benchmark's hashes, of a fixed size whatever the benchmark; it
drops none that match. What passes meets the benchmark's windows in a join. A window that many items share is
joined with the few items of each, so a document's row is repeated for each of these items, never for other documents.

Null texts are empty and match nothing, null items likewise; rows with equal ids and texts count as one. Very long texts are
read whole. Of equally good shifts the one with the earliest token is reported. Only the named columns are read, so others can't clash;
empty tables give empty results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.common import batches, cut, rows_of, texts, type_of

UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
    "kilometre kilometres mg g kg t lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes "
    "ml l liter liters litre litres gallon gallons ms s sec second seconds min minute minutes h hr hour hours day days week "
    "weeks month months year years percent dollar dollars euro euros cent cents usd eur gbp hz khz mhz ghz w kw mw v kv "
    "degree degrees celsius fahrenheit mph kmh kb mb gb tb byte bytes".split()
)
SPELLED_VALUES = {w: k for k, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())}
SPELLED_VALUES |= {w: 10 * k for k, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
SCALES = {"hundred": 100, "thousand": 1_000, "million": 1_000_000, "billion": 1_000_000_000}
TOKEN = re.compile(r"[^\W\d_][^\W_]*(?:['’][^\W\d_]+)*|\d+(?:[.,:/]\d+)*|[.!?\n]")
WORD, CAPITAL, NUMBER, END, UNIT, ONES, TEENS, TENS, SCALE = range(9)  # from ONES on: number words
SLOTS = {CAPITAL: "\0name", UNIT: "\0unit"} | dict.fromkeys((NUMBER, ONES, TEENS, TENS, SCALE), "\0number")
MOST_CACHED = 300_000
MAP_BITS, MOST_VALUE, MOST_WORDS = 24, 200, 15
SPLIT, SAYS = "\x1f", "\x1e"
TEXT_SEED = 42  # that of Spark's xxhash64


def kind_of(token: str) -> int:
    if token in ".!?\n":
        return END
    if token[0].isdigit():
        return NUMBER
    low = token.lower()
    if low in UNITS:
        return UNIT
    if low in SCALES:
        return SCALE
    if low in SPELLED_VALUES:
        return ONES if SPELLED_VALUES[low] < 10 else TEENS if SPELLED_VALUES[low] < 20 else TENS
    return CAPITAL if token[0].isupper() and not token[1:].isupper() else WORD


def spelled(words: list[str]) -> str:
    """The number that a run of number words says, in digits; the words themselves where they say none."""
    total, part, last = 0, None, 0
    for w in map(str.lower, words):
        if w in SCALES:
            part = (1 if part is None else part) * SCALES[w]
            if SCALES[w] > 100:
                total, part = total + part, None
            last = 100
        elif part is None:
            part = last = SPELLED_VALUES[w]
        elif last >= 20 and last % 10 == 0 and SPELLED_VALUES[w] < (100 if last == 100 else 10):
            part, last = part + SPELLED_VALUES[w], SPELLED_VALUES[w]
        else:
            return " ".join(words).lower()
    return str(total + (part or 0))


def digest(text: str) -> int:
    return xxhash.xxh64_intdigest(text)


class Known(dict):
    """Numbers tokens as they are met; keeps the kind and hash of each."""

    def __init__(self):
        self.kinds, self.hashes = np.empty(1 << 16, np.int8), np.empty(1 << 16, np.uint64)

    def __missing__(self, token: str) -> int:
        k = self[token] = len(self)
        if k == len(self.kinds):
            self.kinds, self.hashes = np.resize(self.kinds, 2 * k), np.resize(self.hashes, 2 * k)
        self.kinds[k], self.hashes[k] = kind_of(token), digest(token.lower())
        return k


class Template:
    """The slots and words of a text: hashes of the template and of the values, which positions are slots, and their tokens."""

    __slots__ = ("hashes", "values", "slot", "first", "last", "tokens", "kinds")

    def __init__(self, text: str, known: Known, slot_hash: np.ndarray):
        self.tokens = TOKEN.findall(text)
        at = np.fromiter(map(known.__getitem__, self.tokens), np.int64, len(self.tokens))
        kinds, values = known.kinds[at], known.hashes[at]
        before = np.concatenate([np.array([END], np.int8), kinds[:-1]])
        kinds = np.where((kinds == UNIT) & (before != NUMBER) & (before < ONES), WORD, kinds)
        kept = np.flatnonzero(kinds != END)
        values = values[kept]
        goes_on = (kinds >= ONES) & (before >= ONES) & ((kinds == SCALE) | (before == SCALE) | (kinds == ONES) & (before == TENS))  # "one two" are two numbers
        inside = (goes_on | (kinds == CAPITAL) & (before == CAPITAL))[kept]  # of a name or of one number all words but the first
        if inside.any():
            starts = np.flatnonzero(~inside)
            within = np.arange(len(kept)) - np.repeat(starts, np.diff(np.append(starts, len(kept))))
            self.first, self.last = kept[starts], kept[np.append(starts[1:], len(kept)) - 1]
            with np.errstate(over="ignore"):
                self.values = np.add.reduceat(values * np.power(np.uint64(31), within.astype(np.uint64)), starts)
        else:
            self.first, self.last, self.values = kept, kept, values
        self.kinds = kinds = kinds[self.first]
        self.slot = kinds != WORD
        self.hashes = np.where(self.slot, slot_hash[kinds], self.values)

    def value(self, k: int) -> str:
        """What a slot holds; a number in words in digits after its words, as "seven" and "7" are the same but may become different numbers."""
        words = self.tokens[self.first[k] : self.last[k] + 1]
        found = " ".join(words).lower()
        found = found if len(found) <= MOST_VALUE else f"#{digest(found)}"
        return f"{found}{SAYS}{spelled(words) if len(words) <= MOST_WORDS else found}" if self.kinds[k] >= ONES else found

    def slots(self, at: int, size: int, literals: int) -> str:
        """The slots of a window as they are written, in order; none where it counts by its values."""
        slot = self.slot[at : at + size]
        return SPLIT.join(self.value(at + k) for k in np.flatnonzero(slot).tolist()) if size - np.count_nonzero(slot) >= literals else ""


class Windows:
    """Hashes of the windows of a template."""

    def __init__(self, window: int, literals: int):
        self.window, self.literals = window, literals
        self.power = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(window)], np.uint64)
        self.slot_hash = np.array([digest(SLOTS.get(k, "")) for k in range(9)], np.uint64)
        self.known = Known()

    def template(self, text: str) -> Template:
        if len(self.known) > MOST_CACHED:
            self.known = Known()
        return Template(text, self.known, self.slot_hash)

    def rolled(self, hashes: np.ndarray, size: int, seed: int, at: np.ndarray | None = None) -> np.ndarray:
        """A hash of the ``size`` values from each place on, or from the places ``at`` alone."""
        n = len(hashes)
        hashes = hashes ^ (hashes >> np.uint64(29))
        total = np.zeros(max(0, n - size + 1) if at is None else len(at), np.uint64)
        with np.errstate(over="ignore"):
            for k in range(size if n >= size else 0):
                total += (hashes[k : n - size + 1 + k] if at is None else hashes[at + k]) * self.power[k]
            return (total ^ (total >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(size + (seed << 8))

    def of(self, t: Template) -> np.ndarray:
        """The hash at each position: of the form, or where there are too few words of the values."""
        size = self.window
        if len(t.hashes) < size:
            return np.empty(0, np.uint64)
        words = np.concatenate([[0], np.cumsum(~t.slot)])
        few = np.flatnonzero((words[size:] - words[: len(words) - size]) < self.literals)
        out = self.rolled(t.hashes, size, 0)
        if len(few):
            out[few] = self.rolled(t.values, size, 1, few)
        return out

    def short(self, t: Template, size: int) -> np.ndarray:
        """The hash of the values of every run of ``size`` tokens, fewer than a window."""
        return self.rolled(t.values, size, 2)

    def whole(self, t: Template) -> np.ndarray:
        return self.rolled(t.values, len(t.values), 3)


WINDOWS = "key bigint, pos bigint, size int, hash bigint, slots string, n_windows bigint"


def windows_of(items: DataFrame, window: int, literals: int, shortest: int) -> DataFrame:
    """item_id, key (a hash of the text), pos, size, hash, slots, n_windows: of every window of every item."""
    ddl = f"item_id {type_of(items, 'item_id')}, {WINDOWS}"

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Windows(window, literals)

        def found():
            for batch in it:
                for item_id, text in rows_of(batch, "item_id", "text"):
                    t = made.template(text)
                    n = len(t.first)
                    size = min(n, window)
                    hashes = made.of(t) if n >= window else made.short(t, n) if n >= shortest else made.whole(t) if n else []
                    for at, h in enumerate(hashes):
                        yield item_id, key_of(text), at, size, h.astype(np.int64).item(), t.slots(at, size, literals) if size == window else "", len(hashes)

        yield from batches(found(), ddl, 20_000)

    return texts(items, "item_id").mapInArrow(each, ddl)


def key_of(text: str) -> int:
    return np.uint64(xxhash.xxh64_intdigest(text, TEXT_SEED)).astype(np.int64).item()


def bitmap(items: DataFrame) -> np.ndarray:
    """One bit for each value of a hash's lower ``MAP_BITS`` bits: whether an item's window has it. At most 2 ** MAP_BITS / 64 rows reach the driver."""
    low = F.col("hash").bitwiseAND(F.lit((1 << MAP_BITS) - 1))
    one = F.expr("shiftleft(1L, cast(hash & 63 AS int))")
    rows = items.select(F.shiftright(low, 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    words = np.zeros((1 << MAP_BITS) // 64, np.int64)
    words[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return words.view(np.uint64)


def in_map(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The positions whose hash the bitmap may hold."""
    low = hashes & np.uint64((1 << MAP_BITS) - 1)
    return np.flatnonzero((words[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1))


def windows(docs: DataFrame, window: int, literals: int, shortest: int, short_sizes: list[int], words: np.ndarray) -> DataFrame:
    """doc_id, key, pos, size, hash, slots of the documents' windows that the bitmap may hold; of fewer tokens than a window for sizes that items have."""
    ddl = f"doc_id {type_of(docs, 'doc_id')}, key bigint, pos bigint, size int, hash bigint, slots string"

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Windows(window, literals)

        def found():
            for batch in it:
                for doc_id, text in rows_of(batch, "doc_id", "text"):
                    t = made.template(text)
                    n, key = len(t.first), None
                    parts = [(window, made.of(t)), *((k, made.short(t, k)) for k in short_sizes if shortest <= k <= n)]
                    if 0 < n < shortest:
                        parts.append((n, made.whole(t)))
                    for size, hashes in parts:
                        for at in in_map(words, hashes).tolist():
                            key = key_of(text) if key is None else key
                            yield doc_id, key, at, size, hashes[at].astype(np.int64).item(), t.slots(at, size, literals) if size == window else ""

        yield from batches(found(), ddl, 20_000)

    return texts(docs, "doc_id").mapInArrow(each, ddl)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = 6, literals: int = 3, coverage: float = 0.4, least: int = 3, shortest: int = 3, slack: int = 8) -> DataFrame:
    """One row per document (id and text) and item found there.

    doc_id, key (Spark's xxhash64 of the text), item_id, n_windows (the item's), n_matched, n_verbatim (with unchanged slots), coverage, n_slots (distinct
    values compared), n_changed, consistent, first_token (of the match, in the document), match: verbatim or reparameterised.
    """
    items = cut(windows_of(benchmark, window, literals, shortest).select("item_id", F.col("pos").alias("item_pos"), "size", "hash", F.col("slots").alias("item_slots"), "n_windows"))
    short_sizes = sorted(r["size"] for r in items.where(F.col("size") < window).select("size").distinct().collect())  # fewer than ``window``
    of_docs = windows(docs, window, literals, shortest, short_sizes, bitmap(items))
    met = of_docs.join(items, ["hash", "size"]).withColumn("shift", F.col("pos") - F.col("item_pos"))
    band = lambda name, x: F.struct(F.lit(name).alias("by"), F.floor(x).cast("bigint").alias("place"))
    half = slack // 2
    met = met.withColumn("at", F.explode(F.array(band("shift", F.col("shift")), band("low", F.col("shift") / slack), band("high", (F.col("shift") + half) / slack))))
    values = lambda c: F.when(F.col(c).contains(SAYS), F.regexp_replace(c, f"[^{SPLIT}{SAYS}]*{SAYS}", "")).otherwise(F.col(c))
    met = met.withColumn("values", values("slots")).withColumn("item_values", values("item_slots"))
    same = F.col("values") == F.col("item_values")
    pair = F.arrays_zip(F.split("item_slots", SPLIT).alias("was"), F.split("item_values", SPLIT).alias("value"), F.split("values", SPLIT).alias("now"))
    counted = met.groupBy("doc_id", "key", "item_id", "at").agg(
        F.max("n_windows").alias("n_windows"),
        F.count_distinct("item_pos").alias("n_matched"),
        F.count_distinct(F.when(same, F.col("item_pos"))).alias("n_verbatim"),
        F.array_distinct(F.flatten(F.collect_set(F.when(F.col("item_slots") != "", pair)))).alias("mapped"),
        F.min("pos").alias("first_token"),
    )
    changed = F.size(F.filter("mapped", lambda p: p["value"] != p["now"]))
    judged = counted.select("*", (F.col("n_matched") / F.col("n_windows")).alias("coverage"), F.size("mapped").cast("bigint").alias("n_slots"), changed.cast("bigint").alias("n_changed"), (F.size(F.array_distinct(F.transform("mapped", lambda p: p["was"]))) == F.size("mapped")).alias("consistent"))
    enough = lambda n: (F.col(n) >= coverage * F.col("n_windows")) & (F.col(n) >= F.least(F.lit(least), "n_windows"))
    hits = judged.where(enough("n_verbatim") | enough("n_matched") & F.col("consistent"))
    best = hits.groupBy("doc_id", "key", "item_id").agg(F.max_by(F.struct("n_windows", "n_matched", "n_verbatim", "coverage", "n_slots", "n_changed", "consistent", "first_token"), F.struct("n_matched", "n_verbatim", F.col("at.by") == "shift", -F.col("first_token"))).alias("b"))
    return best.select("doc_id", "key", "item_id", "b.*", F.when(F.col("b.n_matched") == F.col("b.n_verbatim"), "verbatim").otherwise("reparameterised").alias("match"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``matches`` without the key: documents that share an id have a row each."""
    return matches(docs, benchmark, **options).drop("key")


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents in which an item was found; a row whose id is null or repeated goes only with its own text."""
    found = matches(docs, benchmark, **options).select(F.col("doc_id").alias("__found"), F.col("key").alias("__key")).distinct()
    text_key = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    return docs.join(found, (text_key == F.col("__key")) & docs["doc_id"].eqNullSafe(F.col("__found")), "left_anti")
