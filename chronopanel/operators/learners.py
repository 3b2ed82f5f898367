"""Cross-fitted nuisance models and their combination.

Learners are those of pyspark.ml; the reference families without one there (extremely randomised trees, boosters with native
missing values) have no substitute by name, see the README. Coefficients and Gram matrices reach the driver, rows don't.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import chain
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from chronopanel.functions.stats import expit, logit


def logistic(label: str) -> LogisticRegression:
    return LogisticRegression(featuresCol="_vector", labelCol=label, regParam=0.01, maxIter=50)


def learner(name: str, features: list[str], label: str, seed: int = 42, trees: int = 20) -> Pipeline:
    """Median imputation, standardisation and a classifier: logistic, forest or boosted."""
    filled = [f"_filled_{c}" for c in features]
    model = {
        "logistic": logistic(label),
        "forest": RandomForestClassifier(featuresCol="_vector", labelCol=label, numTrees=trees, maxDepth=6, seed=seed),
        "boosted": GBTClassifier(featuresCol="_vector", labelCol=label, maxIter=trees, maxDepth=3, seed=seed),
    }[name]
    return Pipeline(stages=[Imputer(strategy="median", relativeError=0.001, inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_raw_vector"), StandardScaler(inputCol="_raw_vector", outputCol="_vector", withMean=True), model])


@dataclass
class FoldModel:
    """A fitted pipeline, or where that can't be fitted the smoothed rate and why."""

    features: list[str]
    model: PipelineModel | None
    rate: float
    fallback: str | None = None

    def score(self, rows: DataFrame, out: str) -> DataFrame:
        if self.model is None:
            return rows.withColumn(out, F.lit(self.rate))
        return self.model.transform(rows).withColumn(out, vector_to_array("probability")[1]).select(*rows.columns, out)


def seen(features: list[str], label: str) -> list[Column]:
    """Aggregates that a fit needs of its rows: how many, the events, each feature's ends and missing values."""
    missing = lambda c: F.coalesce(F.isnan(F.col(c).cast("double")), F.lit(True))
    return [F.count("*").alias("n"), F.sum(label).alias("e"), *chain.from_iterable((F.min(c).alias(f"lo_{c}"), F.max(c).alias(f"hi_{c}"), F.count_if(missing(c)).alias(f"no_{c}")) for c in features)]


def usable(parts: list[Row], features: list[str]) -> tuple[list[str], float, str | None]:
    """The features that vary over ``parts`` (a row of ``seen`` each), the smoothed rate, and why nothing can be fitted, if so. No rows fail."""
    order = lambda x: (x != x, x)  # noqa: E731  NaN is the largest, as in Spark
    n, e = sum(r["n"] for r in parts), sum(r["e"] for r in parts if r["n"])
    if not n:
        raise ValueError("the training risk set is empty")
    ends = {c: [[r[f"{end}_{c}"] for r in parts if r[f"{end}_{c}"] is not None] for end in ("lo", "hi")] for c in features}
    kept = [c for c, (lo, hi) in ends.items() if lo and min(lo, key=order) != max(hi, key=order)]
    return kept, (e + 1) / (n + 2), "one class" if not 0 < e < n else None if kept else "no features"


def fit_fold_model(rows: DataFrame, features: list[str], label: str, name: str = "logistic") -> FoldModel:
    """A learner without the features that are constant or empty in ``rows``. One class or no feature left gives the smoothed rate; no rows fail."""
    kept, rate, why = usable([rows.agg(*seen(features, label)).first()], features)
    return FoldModel(kept, None if why else learner(name, kept, label).fit(rows), rate, why)


#: Fits of a call of ``crossfit`` that run at a time; each keeps its training rows' features in executor memory (8 bytes a value), or on disk.
AT_ONCE = 5


def crossfit(rows: DataFrame, features: list[str], label: str, name: str = "logistic", fold: str = "fold", out: str = "p", score_rows: DataFrame | None = None) -> DataFrame:
    """Out-of-fold probabilities: each fold's rows (of ``score_rows`` if given) are scored by a model of the other folds.

    What the fits must know of their rows is one aggregate by fold. Where no fitted or scored row lacks a feature, nothing is to be imputed, and the logistic learner, which
    standardises by itself, is fitted on vectors assembled once for all folds."""
    target, parts = score_rows if score_rows is not None else rows, []
    by = {r[fold]: r for r in rows.groupBy(fold).agg(*seen(features, label)).collect()}  # a row for each fold
    without = {k: usable([r for j, r in by.items() if j != k], features) for k in sorted(by)}
    complete = name == "logistic" and not any(r[f"no_{c}"] for r in by.values() for c in features)
    if complete and score_rows is not None:
        complete = not sum(v for k, v in target.agg(*seen(features, label)).first().asDict().items() if k.startswith("no_"))
    vectors = VectorAssembler(inputCols=features, outputCol="_vector").transform(rows).select(fold, label, "_vector").persist() if complete else rows

    def fitted(k) -> FoldModel:
        kept, rate, why = without[k]
        train = vectors.where(F.col(fold) != k)
        if why:
            return FoldModel(kept, None, rate, why)
        if not complete:
            return FoldModel(kept, learner(name, kept, label).fit(train), rate)
        # a feature that is constant in this training part gets the coefficient 0
        return FoldModel(features, PipelineModel([VectorAssembler(inputCols=features, outputCol="_vector"), logistic(label).fit(train)]), rate)

    try:
        with ThreadPool(AT_ONCE) as pool:
            models = dict(zip(without, pool.starmap(lambda f, k: f(k), [(inheritable_thread_target(rows.sparkSession)(fitted), k) for k in without]), strict=True))
    finally:
        if complete:
            vectors.unpersist()
    for k, model in models.items():
        parts.append(model.score(target.where(F.col(fold) == k), out))
    return reduce(DataFrame.unionByName, parts) if parts else target.withColumn(out, F.lit(None).cast("double")).where("false")


def gram(rows: DataFrame, columns: list[str], y: str) -> tuple[np.ndarray, np.ndarray, float]:
    """(X'X / n, X'y / n, y'y / n) of a few columns, from one aggregate."""
    cells = [F.avg(F.col(a) * F.col(b)) for a in columns for b in columns] + [F.avg(F.col(a) * F.col(y)) for a in columns] + [F.avg(F.col(y) * F.col(y))]
    r = np.array([x or 0.0 for x in rows.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).first()], float)
    k = len(columns)
    return r[: k * k].reshape(k, k), r[k * k : k * k + k], float(r[-1])


def simplex_weights(a: np.ndarray, b: np.ndarray, steps: int = 2000) -> np.ndarray:
    """Minimises w'Aw - 2 b'w over weights that are at least 0 and sum to 1, by projected gradient steps."""
    k = len(b)
    w, rate = np.full(k, 1 / k), 1 / (2 * np.linalg.eigvalsh(a)[-1] + 1e-12)
    for _ in range(steps):
        v = w - rate * 2 * (a @ w - b)
        s = np.sort(v)[::-1]
        total = np.cumsum(s) - 1
        m = np.nonzero(s - total / np.arange(1, k + 1) > 0)[0][-1]
        w = np.maximum(v - total[m] / (m + 1), 0)
    return w


def super_learner(rows: DataFrame, features: list[str], label: str, names: list[str], fold: str = "fold") -> tuple[DataFrame, dict[int, tuple[dict[str, float], str | None]]]:
    """Nested: out-of-fold probabilities ``p_<learner>`` and ``p``, and for each outer fold the weights and why they fell back, if they did.

    The outer training part's own folds are the inner ones: learners fitted without two folds predict one of them, and the convex
    combination of least squared error on these predictions is chosen. All learners are then fitted anew on the whole training part. With fewer
    than two inner folds the first learner stands alone, with one class the smoothed rate. A pair of folds left out is unordered, so its fit serves both.
    """
    pairs: dict[tuple, FoldModel] = {}

    def without(k: int, j: int, n: str) -> FoldModel:
        key = (min(k, j), max(k, j), n)
        if key not in pairs:
            pairs[key] = fit_fold_model(rows.where((F.col(fold) != k) & (F.col(fold) != j)), features, label, n)
        return pairs[key]

    known, parts, chosen = sorted(r[0] for r in rows.select(fold).distinct().collect()), [], {}  # a row for each fold
    for k in known:
        train, weights, why = rows.where(F.col(fold) != k), {n: float(n == names[0]) for n in names}, None
        ends = train.agg(F.min(label), F.max(label)).first()
        if len(known) < 3:
            why = "fewer than two inner folds"
        elif ends[0] == ends[1]:
            why = "one class"
        else:
            inner = train
            for n in names:
                inner = reduce(DataFrame.unionByName, [without(k, j, n).score(inner.where(F.col(fold) == j), f"p_{n}") for j in known if j != k])
            a, b, _ = gram(inner, [f"p_{n}" for n in names], label)
            weights = dict(zip(names, simplex_weights(a, b).tolist(), strict=True))
        held = rows.where(F.col(fold) == k)
        for n in names:
            held = fit_fold_model(train, features, label, n).score(held, f"p_{n}")
        parts.append(held.withColumn("p", sum((w * F.col(f"p_{n}") for n, w in weights.items()), F.lit(0.0))))
        chosen[k] = (weights, why)
    return reduce(DataFrame.unionByName, parts), chosen


def save(models: dict[int, FoldModel], path: str, spark: SparkSession) -> None:
    """Each fold's pipeline in a folder of its own, beside one table of what isn't in it."""
    for k, m in models.items():
        if m.model is not None:
            m.model.write().overwrite().save(f"{path}/fold={k}")
    spark.createDataFrame([(k, m.features, m.rate, m.fallback) for k, m in models.items()], "fold bigint, features array<string>, rate double, fallback string").coalesce(1).write.mode("overwrite").parquet(f"{path}/folds")


def load(path: str, spark: SparkSession) -> dict[int, FoldModel]:
    rows = spark.read.parquet(f"{path}/folds").collect()  # a row for each fold
    return {r["fold"]: FoldModel(r["features"], None if r["fallback"] else PipelineModel.load(f"{path}/fold={r['fold']}"), r["rate"], r["fallback"]) for r in rows}


def cached(spark: SparkSession, folder: str, key: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table kept under ``key`` (of contents and settings), built and written first if it isn't there."""
    path = f"{folder}/{key}"
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def ridge(rows: DataFrame, features: list[str], y: str, penalty: float = 1.0) -> np.ndarray | None:
    """Intercept and coefficients of a ridge regression with an unpenalised intercept, from one aggregate of moments. None without rows."""
    k = len(features)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    r = rows.agg(F.count("*").alias("n"), F.avg(y).alias("y"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.covar_pop(features[i], features[j]).alias(f"s{i}_{j}") for i, j in pairs], *[F.covar_pop(c, y).alias(f"c{i}") for i, c in enumerate(features)]).first()
    if not r["n"]:
        return None
    s = np.zeros((k, k))
    for i, j in pairs:
        s[i, j] = s[j, i] = r[f"s{i}_{j}"] or 0.0
    sd = np.sqrt(np.diag(s))
    live = sd > 1e-12
    scale = np.where(live, sd, 1.0)
    z = (s / scale[:, None] / scale[None, :]) * r["n"] + penalty * np.eye(k)
    beta = np.linalg.solve(z, np.array([r[f"c{i}"] or 0.0 for i in range(k)]) / scale * r["n"]) / scale * live
    return np.concatenate([[r["y"] - beta @ np.array([r[f"m{i}"] or 0.0 for i in range(k)])], beta])


def predicted(beta: np.ndarray, features: list[str]):
    return F.lit(float(beta[0])) + sum((float(b) * F.col(c) for b, c in zip(beta[1:], features, strict=True)), F.lit(0.0))


def importances(rows: DataFrame, features: list[str], label: str, fold: str = "fold", name: str = "logistic", top: int | None = None) -> DataFrame:
    """learner, feature, importance, n_folds, place: the mean over folds, the largest ``top`` of them if given, ties by name.

    Absolute standardised coefficients of the logistic learner, the share of impurity removed for trees. A feature that is constant in a fold's training part is not in that fold's
    model, and the mean is over the others; a fold without a model adds nothing. The table has a row for each feature and fold.
    """
    folds, out = [r[0] for r in rows.select(fold).distinct().collect()], []
    for k in sorted(folds):
        fitted = fit_fold_model(rows.where(F.col(fold) != k), features, label, name)
        if fitted.model is not None:
            last = fitted.model.stages[-1]
            found = last.coefficients if name == "logistic" else last.featureImportances
            out += [(f, abs(float(c))) for f, c in zip(fitted.features, found.toArray(), strict=True)]
    means = rows.sparkSession.createDataFrame(out, "feature string, x double").groupBy("feature").agg(F.avg("x").alias("importance"), F.count("*").alias("n_folds"))
    placed = means.select(F.lit(name).alias("learner"), "*", F.row_number().over(Window.orderBy(F.desc("importance"), "feature")).cast("bigint").alias("place"))  # a row for each feature
    return placed.where(F.col("place") <= top) if top else placed


def calibration_line(scored: DataFrame, y: str = "y", p: str = "p", steps: int = 25) -> tuple[float, float] | None:
    """Intercept and slope of an unpenalised logistic regression of y on logit(p), by Newton steps of one aggregate each.

    None where there is one class or the logits don't vary.
    """
    z = logit(F.col(p))
    r = scored.agg(F.min(y), F.max(y), F.min(z), F.max(z)).first()
    if r[0] is None or r[0] == r[1] or r[3] - r[2] < 1e-9:
        return None
    a, b = 0.0, 1.0
    for _ in range(steps):
        q = expit(F.lit(a) + F.lit(b) * z)
        e, w = F.col(y) - q, q * (1 - q)
        g = scored.agg(F.sum(e), F.sum(e * z), F.sum(w), F.sum(w * z), F.sum(w * z * z)).first()
        det = g[2] * g[4] - g[3] * g[3]
        if abs(det) < 1e-12:
            return None
        da, db = (g[4] * g[0] - g[3] * g[1]) / det, (g[2] * g[1] - g[3] * g[0]) / det
        a, b = a + da, b + db
        if abs(da) + abs(db) < 1e-9:
            break
    return a, b
