"""Texts made of shared passages: no pairs for the unlike ones, all links for the alike ones."""

import random

from chronopanel.llm import simhash


def test_shared_passages_make_no_pairs(spark, monkeypatch):
    r, seen, inner = random.Random(1), [], simhash.across

    def counted(*args):
        seen.append(simhash.cut(inner(*args)))
        return seen[-1]

    monkeypatch.setattr(simhash, "across", counted)
    passages = [" ".join(f"p{k}w{r.randrange(400)}" for _ in range(30)) for k in range(20)]
    texts = [" ".join(r.sample(passages, 5)) for _ in range(300)]
    found = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {x.doc_id: x.component for x in found.collect()}
    sets = [{tuple(t.split()[i : i + 5]) for i in range(146)} for t in texts]
    alike = [(a, b) for a in range(300) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    parent = list(range(300))
    for a, b in alike:
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[max(a, b)] = min(a, b)
    assert alike and len(set(got.values())) == sum(parent[i] == i for i in range(300)) and all(got[a] == got[b] for a, b in alike)
    assert seen[0].count() < 30
