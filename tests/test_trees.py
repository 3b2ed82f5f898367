"""Tree ensembles: splits by brute force, missing values, signed targets, constant features, held-out folds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import trees


def frame(spark, x, y, folds=None):
    rows = [(k, int(folds[k]) if folds is not None else k % 3, *(None if np.isnan(v) else float(v) for v in row), float(t)) for k, (row, t) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, fold long, " + ", ".join(f"x{i} double" for i in range(x.shape[1])) + ", y double").repartition(3)


def predicted(e, df):
    return {r.id: r.p for r in e.score(df, "p").collect()}


def test_first_split_by_brute_force(spark):
    """The root of each fold's first tree has the greatest gain over all features, cuts and directions of the other folds' rows."""
    draw = np.random.default_rng(2)
    x = draw.integers(0, 12, (90, 3)).astype(float)
    x[draw.uniform(size=x.shape) < 0.2] = np.nan
    y = np.where(np.isnan(x[:, 1]), 3.0, np.where(x[:, 2] > 6, 1.0, 0.0)) + draw.normal(size=90) / 5
    df = frame(spark, x, y)
    e = trees.boosted(df, ["x0", "x1", "x2"], "y", "squared", trees=1, depth=1, least=4)
    for k in range(3):
        train = np.arange(90) % 3 != k
        g = y[train].mean() - y[train]
        worth = lambda m: g[m].sum() ** 2 / (m.sum() + 1)  # noqa: E731, B023
        best = -np.inf
        for f in range(3):
            v = x[train, f]
            for at in np.unique(x[~np.isnan(x[:, f]), f]):
                for left in (True, False):
                    m = np.where(np.isnan(v), left, v <= at)
                    if min(m.sum(), (~m).sum()) >= 4:
                        best = max(best, worth(m) + worth(~m))
        tree = e.trees[k][0]
        f, v = tree["feature"][0], x[train, tree["feature"][0]]
        bins = np.searchsorted(e.cuts[f], v, side="left")
        m = np.where(np.isnan(v), tree["left"][0], bins <= tree["bin"][0])
        assert worth(m) + worth(~m) == pytest.approx(best)
        assert tree["value"][1] == pytest.approx(-g[m].sum() / (m.sum() + 1)) and tree["value"][2] == pytest.approx(-g[~m].sum() / ((~m).sum() + 1))


@pytest.mark.parametrize("kind", ["boosted", "extra"])
def test_missing_predictors_and_signed_targets(spark, kind):
    x = np.full((80, 2), np.nan)
    x[1:, 0] = np.arange(1, 80)
    y = np.where(np.arange(80) < 40, -2.0, 3.0)
    df = frame(spark, x, y)
    fit = trees.boosted(df, ["x0", "x1"], "y", "squared", trees=12, rate=0.3) if kind == "boosted" else trees.extra(df, ["x0", "x1"], "y", trees=10, depth=4, least=2)
    got = predicted(fit, df)
    assert all(np.isfinite(list(got.values())))
    assert np.mean([got[k] for k in range(1, 40)]) < -1 and np.mean([got[k] for k in range(40, 80)]) > 2
    still = frame(spark, np.full((12, 2), 7.0), np.arange(12.0))
    flat = trees.boosted(still, ["x0", "x1"], "y", "squared", trees=2) if kind == "boosted" else trees.extra(still, ["x0", "x1"], "y", trees=2)
    for k, p in predicted(flat, still).items():
        assert p == pytest.approx(np.mean([v for v in range(12) if v % 3 != k % 3]))


def test_missingness_is_split_on_and_folds_are_held_out(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(150, 2))
    x[draw.uniform(size=150) < 0.4, 0] = np.nan
    y = np.isnan(x[:, 0]).astype(float)
    df = frame(spark, x, y)
    options = {"trees": 3, "depth": 2, "rate": 0.8, "stretch": 2}
    got = predicted(trees.boosted(df, ["x0", "x1"], "y", **options), df)
    assert min(got[k] for k in range(150) if y[k]) > 0.7 and max(got[k] for k in range(150) if not y[k]) < 0.3
    other = df.withColumn("y", F.when(F.col("fold") == 0, 1 - F.col("y")).otherwise(F.col("y")))
    again = predicted(trees.boosted(other, ["x0", "x1"], "y", **options), other)
    assert all(again[k] == pytest.approx(got[k]) for k in range(0, 150, 3)) and any(abs(again[k] - got[k]) > 1e-3 for k in range(1, 150, 3))
    whole = trees.boosted(df, ["x0", "x1"], "y", **(options | {"stretch": 50}))
    assert predicted(whole, df) == pytest.approx(got)
    some = predicted(trees.extra(df, ["x0", "x1"], "y", "logistic", trees=8), df)
    assert np.mean([some[k] for k in range(150) if y[k]]) > np.mean([some[k] for k in range(150) if not y[k]]) + 0.3 and 0 <= min(some.values()) <= max(some.values()) <= 1
    with pytest.raises(ValueError, match="empty"):
        trees.boosted(df.where("fold = 0"), ["x0"], "y")


def test_leaves_need_no_pass(spark, monkeypatch):
    draw, depths, level = np.random.default_rng(4), [], trees.level
    rows = spark.createDataFrame([(i % 3, int(draw.integers(2)), float(draw.normal()), float(i % 7) if i % 5 else None) for i in range(200)], "fold int, y int, a double, b double")
    monkeypatch.setattr(trees, "level", lambda *x: depths.append(x[4]) or level(*x))
    e = trees.boosted(rows, ["a", "b"], "y", trees=2, depth=2)
    assert depths == [0, 1, 0, 1]
    data = [(r.fold, r.y, r.a, r.b) for r in rows.collect()]
    for k in range(3):  # values of leaves by brute force
        mine = [r for r in data if r[0] != k]
        bins = np.array([[trees.MISSING if v is None else sum(c < v for c in cuts) for v, cuts in zip(r[2:], e.cuts)] for r in mine], np.uint8)
        margin, y = np.full(len(mine), e.base[k]), np.array([r[1] for r in mine])
        for tree in e.trees[k]:
            p, at = 1 / (1 + np.exp(-margin)), trees.leaf_of(tree, bins)
            for x in np.unique(at):
                here = at == x
                assert tree["value"][x] == pytest.approx(-(p - y)[here].sum() / ((p * (1 - p))[here].sum() + 1))
            margin += e.rate * tree["value"][at]
