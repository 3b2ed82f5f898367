"""Ranks, quantiles and numbers by ranges against numpy; fingerprints and caches of fits."""

import numpy as np
import pytest

from chronopanel.operators import checks, metrics, nested, ranges

from test_nuisance import FEATURES, MEASURES, POLICIES, SCHEMA, trajectories


@pytest.fixture(scope="module")
def values(spark):
    draw = np.random.default_rng(4)
    rows = [(("a" if k % 3 else "b" if k % 2 else None), None if k % 17 == 0 else float(draw.integers(0, 40)) / 4, int(k % 5 == 0)) for k in range(700)] + [("one", 2.5, 1), ("none", None, 0)]
    return rows, spark.createDataFrame(rows, "g string, v double, y int").repartition(5)


def test_quantiles_and_ranks(spark, values):
    rows, df = values
    shares = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r.q for r in ranges.quantiles(df, ["g"], "v", shares).collect()}
    of = {g: np.array([v for h, v, _ in rows if h == g and v is not None]) for g in {r[0] for r in rows}}
    assert got.keys() == {g for g, v in of.items() if len(v)}
    for g, q in got.items():
        assert q == pytest.approx(np.quantile(of[g], shares))
    ranked = ranges.average_ranks(df, ["g"], "v", "rank").collect()
    assert len(ranked) == len(rows)
    for r in ranked:
        assert r.rank is None if r.v is None else r.rank == pytest.approx((of[r.g] < r.v).sum() + ((of[r.g] == r.v).sum() + 1) / 2)
    assert ranges.quantiles(df.limit(0), ["g"], "v", shares).count() == 0


def test_areas_by_pairs(spark, values):
    rows, df = values
    got = metrics.binary_metrics(df.where("g = 'a' AND v IS NOT NULL"), "g", "y", "v").first()
    one, zero = ([v for g, v, y in rows if g == "a" and v is not None and y == k] for k in (1, 0))
    assert got.auc == pytest.approx(np.mean([(x > z) + (x == z) / 2 for x in one for z in zero]))
    precision = [sum(x >= t for x in one) / sum(x >= t for x in one + zero) for t in one]
    assert got.average_precision == pytest.approx(np.mean(precision))


def test_numbers_of_composite_keys(spark):
    rows = [(k % 4, None if k % 5 == 0 else f"s{k % 3}", k % 2) for k in range(120)]
    df = spark.createDataFrame(rows, "a long, b string, c long").repartition(7)
    want = sorted(set(rows), key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))
    assert {tuple(r)[:3]: r.n for r in ranges.dense_numbers(df, ["a", "b", "c"], "n").collect()} == {r: i for i, r in enumerate(want)}
    numbered = sorted(ranges.row_numbers(df, ["a"], "n").collect(), key=lambda r: r.n)
    assert [r.n for r in numbered] == list(range(120))
    assert [tuple(r)[:3] for r in numbered] == sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or "", r[2]))


def test_fingerprints_tell_fields_and_nulls_apart(spark):
    def of(*rows, kind="a string, b string"):
        return checks.content_fingerprint(spark.createDataFrame(list(rows), kind), ["a", "b"]).first().fingerprint

    different = [of(("a|b", "c")), of(("a", "b|c")), of((None, "c")), of(("\\N", "c")), of(("n", "c")), of(("", "c")), of(("a|b", "c"), ("a|b", "c")), of(("1:x", "")), of(("", "1:x")), of(), of((1, 2), kind="a int, b int"), of((1, 2), kind="a long, b int")]
    assert len(set(different)) == len(different)
    assert of(("x", "y"), ("z", None)) == of(("z", None), ("x", "y"))


def test_fits_are_read_back(spark, tmp_path, monkeypatch):
    """A second run over the same rows fits nothing; other rows, policies or settings do."""
    inner, fits = nested.fit, []
    monkeypatch.setattr(nested, "fit", lambda *a, **k: fits.append(1) or inner(*a, **k))

    def run(rows, policies=POLICIES):
        df = spark.createDataFrame(rows, SCHEMA)
        episodes, d = nested.prepared(df, ["entity", "inserted"], FEATURES, policies, MEASURES, 4, 1.0, None, 1)
        found = nested.cached_fit(df, episodes, d, FEATURES, f"{tmp_path}/fits")
        return found, {tuple(r)[:6]: tuple(r)[6:] for r in nested.scores(episodes, ["entity", "inserted"], found).collect()}

    rows = trajectories()
    first, scores = run(rows)
    again, same = run(rows[::-1])
    assert len(fits) == 1 and scores.keys() == same.keys() and all(same[k] == pytest.approx(v) for k, v in scores.items()) and len(again.records) == len(first.records) == 51
    run([(*rows[0][:12], rows[0][12] + 1, *rows[0][13:]), *rows[1:]])
    run(rows, POLICIES[:1])
    assert len(fits) == 3


def test_exact_p_gives_way_to_chi_squared(spark):
    rows = spark.createDataFrame([("few", 8, 2, 1, 5), ("many", 60_000, 59_000, 58_000, 61_000)], "g string, n11 long, n10 long, n01 long, n00 long").selectExpr("*", "CASE g WHEN 'few' THEN 6.112D ELSE 60.5D END AS chi_squared")
    got = {r.g: r for r in metrics.fisher_p(rows).collect()}
    assert got["few"].fisher_p == pytest.approx(0.03496503, abs=1e-6) != got["few"].chi_squared_p and got["many"].fisher_p == got["many"].chi_squared_p < 1e-10
