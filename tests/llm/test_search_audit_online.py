"""Ranked search, the filter audit and online packing against brute force, and on awkward input."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chronopanel.llm import audit, online, wand

rng = random.Random(11)
VOCABULARY = [f"w{k}" if k % 3 else f"Wö{k}" for k in range(60)]
KIND = "doc_id long, text string, source string, score double, key string, term int, item_id long"
AWKWARD = [(1, None), (2, ""), (None, "w1 w2 no id"), (None, "w1 w2 no id"), (3, "W1 w2, same"), (3, "W1 w2, same"), (3, "w1 w1 other"), (4, " \n\t "), (5, "w7 " * 30_000), (6, "é🙂w1 \x00 w2 tail"), (7, "w1 w2 no id")]


def words(n):
    return " ".join(rng.choice(VOCABULARY) + rng.choice(["", "", ".", ",", "\n"]) for _ in range(n))


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, rng.choice(["a", "b", None]), 1.0, "clash", 7, 8) for i, t in rows], KIND).repartition(parts).cache()


@pytest.fixture(scope="module")
def corpus(spark):
    rows = []
    for k in range(80):
        t = words(rng.choice([2, 20, 80, 300]))
        rows += [t, t, t + " $ tail", "ABC " * 220] if k % 8 == 0 else [t]
    return table(spark, list(enumerate(rows)))


# Ranked search


def brute_search(docs, items, k):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    of = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower))
    counts = [(i, Counter(of(t))) for i, t in docs if of(t)]
    n, size = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 100 - 75 + (75 * sum(c.values()) * n) // size
            scored.append((sum(w.get(t, 0) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in of(text)), i))
        best = sorted((s for s in scored if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return sorted(out, key=repr)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("most_postings", [1, 400, 10**6])
def test_search_by_brute_force(spark, corpus, most_postings):
    docs = [(r.doc_id, r.text) for r in corpus.collect()]
    items = [(i, words(n)) for i, n in enumerate([1, 2, 5, 40, 200])] + [(9, "none of these"), (10, "w1 w1 w1 W1 wö3")]
    queries = spark.createDataFrame(items, "item_id long, text string")
    assert found(wand.ranked(corpus, queries, 7, most_postings=most_postings)) == brute_search(docs, items, 7)
    assert found(wand.ranked(corpus, queries, 3, most_terms=4, most_in_block=2)) == brute_search(docs, items, 3)


def test_search_awkward(spark):
    items = [(0, "w1 w2"), (0, "w7"), (None, "w2 tail"), (1, None), (2, "")]
    docs, queries = table(spark, AWKWARD), spark.createDataFrame(items, "item_id long, text string")
    assert found(wand.ranked(docs, queries, 4)) == brute_search(AWKWARD, items, 4)
    assert wand.ranked(docs.limit(0), queries).count() == wand.ranked(docs, queries.limit(0)).count() == 0


def test_block_boundaries_are_the_best():
    """Dynamic programming against all ways to cut short lists; and no block is longer than allowed."""
    r = random.Random(3)
    for _ in range(60):
        lists = [np.array([r.randint(1, 50) for _ in range(r.randint(1, 9))]) for _ in range(r.randint(1, 4))]
        gain, starts = np.concatenate(lists), np.cumsum([0, *map(len, lists)])
        cost, most = r.choice([1, 20, 60]), r.choice([2, 3, 9])
        at = wand.cut_points(gain, starts, cost, most, lanes=2)

        def price(g, cuts):
            parts = np.split(g, cuts)
            return sum(len(p) * p.max() - p.sum() + cost for p in parts) if max(map(len, parts)) <= most else 10**9

        for a, b, g in zip(starts[:-1], starts[1:], lists, strict=True):
            ours = [int(x - a) for x in at if a < x < b]
            best = min(price(g, [i + 1 for i in range(len(g) - 1) if m >> i & 1]) for m in range(1 << len(g) - 1))
            assert a in at and price(g, ours) == best


def test_search_skips_blocks():
    """With one high document in few blocks, most postings aren't read."""
    n = 20_000
    count = np.ones(n, np.int32)
    count[[70, 71, 9000]] = 50
    shard = wand.Shard(list(range(n)), np.full(n, 100), np.ones(n, np.int64), np.zeros(n, np.int32), count, n, 100 * n, 2_000_000, 128)
    read, inner = [], shard.read
    shard.read = lambda b, weight, low, high, begin, end, *more: (read.append(int((end - begin).sum())), inner(b, weight, low, high, begin, end, *more))[1]
    assert [r[2] for r in shard.search({0: 5}, 3, [])] == [70, 71, 9000] and sum(read) < n / 4


# Filter audit


def brute_masks(docs):
    smallest = {}
    for i, t in docs:
        k = (i is None, i or 0)
        smallest[t or ""] = min(smallest.get(t or "", k), k)
    out = []
    for i, t in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bits = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), (i is None, i or 0) > smallest[t]]
        out.append((i, sum(b << k for k, b in enumerate(bits))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hash_bits", [64, 1, 2])
def test_masks_by_brute_force(spark, corpus, hash_bits):
    """Fewer bits make hashes collide, so whole texts must decide."""
    docs = [(r.doc_id, r.text) for r in corpus.collect()]
    docs += [(500 + k, t) for k, (_, t) in enumerate(docs[:40])] + [(600 + k, "ab"[k % 2] * 70) for k in range(6)] + [(700 + k, "x" * 2000 + "ab"[k % 2]) for k in range(6)] + AWKWARD
    got = [(r.doc_id, r.mask) for r in audit.with_masks(table(spark, docs), hash_bits=hash_bits).collect()]
    assert sorted(got, key=repr) == brute_masks(docs)


def test_audit_by_brute_force(spark, corpus):
    docs = corpus.collect()
    labels = [(r.doc_id, rng.randint(0, 1), rng.randint(0, 1)) for r in docs[::2]] + [(docs[0].doc_id, 0, 0), (None, 1, 1), (3, None, None)]
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in audit.audit(corpus, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    mask = dict(brute_masks([(r.doc_id, r.text) for r in docs]))
    good, toxic = ({d for d, *x in labels if x[k] == 1} for k in (0, 1))
    for part in {r.source or "" for r in docs}:
        here = [r.doc_id for r in docs if (r.source or "") == part]
        removed = defaultdict(int)
        rows = {}
        for order in map("".join, permutations("ABCDE")):
            left = list(here)
            for step, f in enumerate(order, 1):
                fails = {d for d in here if mask[d] >> "ABCDE".index(f) & 1}
                out = [d for d in left if d in fails]
                left = [d for d in left if d not in fails]
                removed[f] += len(out)
                rows[order, step] = (len(left), len(out), len(fails) - len(out), sum(mask[d] == 1 << "ABCDE".index(f) for d in here), sum(d in good for d in out), sum(d in toxic for d in out))
        for (order, step), row in rows.items():
            assert got[part, order, step] == (*row, removed[order[step - 1]])
    assert len(got) == 600 * len({r.source or "" for r in docs})


def test_audit_awkward(spark):
    labels = spark.createDataFrame([(3, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    rows = audit.audit(table(spark, AWKWARD), labels).collect()
    assert sum(r.kept + r.removed for r in rows if r.filter_order == "ABCDE" and r.step == 1) == len(AWKWARD)
    assert audit.audit(table(spark, AWKWARD).limit(0), labels).count() == 0
    assert audit.audit(table(spark, AWKWARD), labels.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


# Online packing


def whole(rows, docs, size):
    """The pieces of each document make its ids, and sequences have no gaps; returns the sequences' lengths."""
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and zlib.crc32(r.ids) == r.ids_crc32
        got[r.doc_id].append((r.start, r.doc_tokens, ids.tolist()))
        bins[r.sequence_id].append((r.offset, r.length))
    want = defaultdict(list)
    for i, t in docs:
        want[i].append([*exact.encode(t or "", add_special_tokens=False).ids, 0])
    for i, lists in want.items():
        if len(lists) == 1:
            at = []
            for start, of, ids in sorted(got[i]):
                assert start == len(at) and of == len(lists[0])
                at += ids
            assert at == lists[0]
        assert Counter(x for *_, ids in got[i] for x in ids) == Counter(x for ids in lists for x in ids)
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at and length > 0
            at += length
        assert at <= size
    return [sum(n for _, n in b) for b in bins.values()]


@pytest.mark.parametrize(("size", "most_open", "fan_in"), [(64, 4, 2), (64, 1, 2), (1024, 32, 64)])
def test_online_round_trip(spark, corpus, size, most_open, fan_in):
    docs = [(r.doc_id, r.text) for r in corpus.collect()]
    rows = online.pack_online(corpus.repartition(9), size, most_open, fan_in, with_ids=True).collect()
    lengths = whole(rows, docs, size)
    short = sorted(n for n in lengths if n < size)
    assert short == [1 << k for k in range(size.bit_length() - 1) if sum(lengths) % size >> k & 1]
    assert len(rows) <= len(docs) + 2 * len(lengths)


def test_windows_are_bounded_and_best_fit():
    w = online.Windows(10, 2, 0)
    put = lambda n: [(s, [len(p[2]) for p in ps]) for s, ps in w.add((n, 0, np.zeros(n, "<u4"), n))]
    assert put(4) == put(7) == [] and [x[0] for x in w.open] == [4, 7]
    assert put(2) == [] and [x[0] for x in w.open] == [4, 9]  # the fullest with room
    assert put(8) == [(1, [7, 2, 1])] and [x[0] for x in w.open] == [4, 7]  # none fits: the fullest is topped up, the rest opens anew
    assert put(23) == [(3, [10]), (4, [10]), (2, [7, 3])] and len(w.open) == 1


def test_online_awkward(spark):
    rows = online.pack_online(table(spark, AWKWARD), with_ids=True).collect()
    whole(rows, AWKWARD, 1024)
    assert online.pack_online(table(spark, AWKWARD).limit(0)).count() == 0
