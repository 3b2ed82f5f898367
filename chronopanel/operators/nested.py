"""The nested recursion: doubly robust scores whose behaviour models and continuation targets never saw the held-out fold.

For an outer fold k, a training row of fold j needs a next score from models that saw neither k nor j. These auxiliary models are fitted on the
folds outside {j, k}, last stage first, with that set's own fitted scores as targets; the behaviour model behind their ratios comes from the same
folds. The pair is unordered, so (k, j) and (j, k) share them. The outer continuation of fold k is then fitted on the other folds with the auxiliary
held-out scores as targets, and fold k is scored by it, with a behaviour model of the other folds.

Behaviour models are rates by cell, continuations ridges on any number of features and the action, for all policies and measures at once: a stage's
Gram matrix belongs to a fold set and measure alone, so policies share it and add a column of the right side each. Sums are additive and weighted
by how often an entity was drawn, so all bootstrap replicates are fitted in the same passes as the estimate itself.

An episode is one row with an array of its decisions. A pass over the episodes gives the sums of one stage: each task folds the later stages of its
episodes with the models found so far and adds up its part as matrices. To fold them anew costs less than to write and read the running scores of all
sets and policies (about 3 kB for each episode), up to ``stretch`` stages; then the running scores are written once, so the work grows with the
number of stages, not its square. What reaches the driver are sums: fold sets x stages x policies x measures x features squared, never rows.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from hashlib import sha256
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.checkpoints import cut
from chronopanel.operators import checks, learners
from chronopanel.shipping import ship

#: name, day of removal, chance of removal (neither: as observed), clipping bound of the behaviour probability
Policy = tuple[str, int | None, float | None, float]


@dataclass
class Design:
    """What is fitted: ``cells`` distinct values of the behaviour cell (0..), ``center`` of the features, the number of stages and replicates."""

    policies: list[Policy]
    measures: list[str]
    n_folds: int
    stages: int
    cells: int
    center: np.ndarray
    replicates: int = 1
    penalty: float = 1.0
    sets: list[tuple[int, ...]] = field(init=False)

    def __post_init__(self):
        self.sets = [*((k,) for k in range(self.n_folds)), *combinations(range(self.n_folds), 2)]

    @property
    def pairs(self) -> range:
        return range(self.n_folds, len(self.sets))

    @property
    def width(self) -> int:
        return len(self.center) + 2

    @property
    def shape(self) -> tuple[int, int, int]:
        """Of a model: intercept, features and action by policies by measures."""
        return self.width, len(self.policies), len(self.measures)


def gathered(rows: DataFrame, keys: list[str], features: list[str], measures: list[str], times: DataFrame | None = None) -> DataFrame:
    """keys, fold, steps, times: an episode's decisions in order. ``rows``: decision_period (1.. without gaps), day, cell, action_removed, reward_*, risk_*.

    ``times``: entity and an array of how often each replicate drew it; without it everything counts once."""
    numbers = lambda names: F.array(*[F.col(c).cast("double") for c in names])
    step = F.struct(F.col("decision_period").cast("int").alias("t"), F.col("day").cast("int").alias("day"), F.col("cell").cast("int").alias("cell"), F.col("action_removed").cast("int").alias("a"), numbers(features).alias("x"), numbers([f"reward_{m}" for m in measures]).alias("r"), numbers([f"risk_{m}" for m in measures]).alias("risk"))
    of = rows.groupBy(*keys, F.col("fold").cast("int").alias("fold")).agg(F.array_sort(F.collect_list(step)).alias("steps"))
    return of.join(times, "entity", "left") if times is not None else of.withColumn("times", F.array(F.lit(1)))


class Batch:
    """Some episodes as dense arrays: episodes by stages by what there is."""

    def __init__(self, batch: pa.RecordBatch, d: Design):
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        steps = column("steps")
        self.fold, self.size = column("fold").to_numpy(), steps.value_lengths().to_numpy(zero_copy_only=False)
        flat, n, top = steps.flatten(), batch.num_rows, int(self.size.max(initial=0))
        of = lambda c: flat.field(flat.type.get_field_index(c))
        row, at = np.repeat(np.arange(n), self.size), np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)

        def dense(values: np.ndarray) -> np.ndarray:
            out = np.zeros((n, top, *values.shape[1:]), values.dtype)
            out[row, at] = values
            return out

        wide = lambda c, k: of(c).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, k)
        self.day, self.cell, self.a = (dense(of(c).to_numpy(zero_copy_only=False)) for c in ("day", "cell", "a"))
        self.x = dense(np.nan_to_num(wide("x", len(d.center)) - d.center, nan=0.0))  # a missing value is the mean
        self.r, self.risk = dense(wide("r", len(d.measures))), dense(wide("risk", len(d.measures)))
        drawn = column("times")
        lists = drawn.fill_null([0] * d.replicates) if drawn.null_count else drawn
        self.times = lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).T.astype(float)
        at_state = batch.schema.get_field_index("state")
        self.state = None if at_state < 0 else [np.frombuffer(b, float).reshape(d.replicates, len(d.pairs), len(d.policies), len(d.measures)) for b in batch.column(at_state).to_pylist()]

    def chosen(self, d: Design, t: int, g: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For stage t (from 0) and some rows: each policy's chance to remove, the behaviour's, and the ratio of the observed action."""
        p, day, a = g[self.cell[rows, t]], self.day[rows, t], self.a[rows, t][:, None] == 1
        pi = np.stack([np.where(day >= k, 1.0, 0.0) if k is not None else np.full(len(rows), float(c)) if c is not None else p for _, k, c, _ in d.policies], 1)
        bound = np.array([e for *_, e in d.policies])
        used = np.clip(p[:, None], bound, 1 - bound)
        return pi, p, np.where(a, pi / used, (1 - pi) / (1 - used))

    def values(self, d: Design, t: int, beta: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """q_keep and q_remove: rows by policies by measures, 0 outside the risk set."""
        q = beta[0] + np.tensordot(self.x[rows, t], beta[1:-1], 1)
        risk = self.risk[rows, t][:, None, :]
        return risk * q, risk * (q + beta[-1])

    def step(self, d: Design, t: int, g: np.ndarray, beta: np.ndarray, rows: np.ndarray, after: np.ndarray) -> np.ndarray:
        pi, _, ratio = self.chosen(d, t, g, rows)
        keep, remove = self.values(d, t, beta, rows)
        seen = np.where((self.a[rows, t] == 1)[:, None, None], remove, keep)
        pi, ratio = pi[:, :, None], ratio[:, :, None]
        return (1 - pi) * keep + pi * remove + ratio * (self.r[rows, t][:, None, :] + after - seen)

    def next_scores(self, d: Design, t: int, g: np.ndarray, betas: np.ndarray, rows: np.ndarray, start: np.ndarray | None = None, since: int | None = None) -> np.ndarray:
        """The score of the stage after t for ``rows`` (0 where there is none), from the models by stage. ``start``: scores of stage ``since``, if known."""
        after = np.zeros((len(rows), *d.shape[1:])) if start is None else start
        top = int(self.size[rows].max(initial=0)) if since is None else since
        for u in range(top - 1, t, -1):
            live = np.flatnonzero(self.size[rows] > u)
            after[live] = self.step(d, u, g, betas[u], rows[live], after[live])
        return after

    def moments(self, d: Design, t: int, rows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Gram matrices by measure, then right sides by policy and measure, as one vector."""
        z = np.column_stack([np.ones(len(rows)), self.x[rows, t], self.a[rows, t]])
        w = (self.risk[rows, t] > 0) * weight[:, None]
        gram = np.einsum("ni,nm,nj->mij", z, w, z, optimize=True)
        right = np.einsum("ni,nm,npm->ipm", z, w, y, optimize=True)
        return np.concatenate([gram.ravel(), right.ravel()])


#: Numbers of one working array, policies by measures of some episodes: what a task holds of an Arrow batch at a time, whatever the batch's size.
PIECE = 40_000


def pieces(batch: pa.RecordBatch, d: Design) -> Iterator[pa.RecordBatch]:
    rows = max(64, PIECE // max(1, len(d.policies) * len(d.measures)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


#: Numbers of one working array, policies by measures of some episodes: what a task holds of an Arrow batch at a time, whatever the batch's size.
PIECE = 40_000


def pieces(batch: pa.RecordBatch, d: Design) -> Iterator[pa.RecordBatch]:
    rows = max(64, PIECE // max(1, len(d.policies) * len(d.measures)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def length(d: Design) -> int:
    return d.width * d.width * len(d.measures) + int(np.prod(d.shape))


def solved(m: np.ndarray, d: Design) -> np.ndarray:
    """Coefficients from ``moments``: ridges on standardised features with a free intercept. A feature without spread has slope 0; a measure without rows 0 throughout."""
    k, n_measures = d.width, len(d.measures)
    grams, right, beta = m[: k * k * n_measures].reshape(n_measures, k, k), m[k * k * n_measures :].reshape(d.shape), np.zeros(d.shape)
    for i, gram in enumerate(grams):
        n = gram[0, 0]
        if n <= 0:
            continue
        mean, y_mean = gram[0, 1:] / n, right[0, :, i] / n
        cov = gram[1:, 1:] / n - np.outer(mean, mean)
        var = np.diag(cov)
        live = var > 1e-12
        sd = np.where(live, np.sqrt(np.maximum(var, 1e-300)), 1.0)
        z = n * np.where(np.outer(live, live), cov / np.outer(sd, sd), 0.0) + d.penalty * np.eye(k - 1)
        rhs = n * (right[1:, :, i] / n - np.outer(mean, y_mean)) / sd[:, None] * live[:, None]
        slopes = np.linalg.solve(z, rhs) / sd[:, None] * live[:, None]
        beta[0, :, i], beta[1:, :, i] = y_mean - mean @ slopes, slopes
    return beta


def summed(episodes: DataFrame, d: Design, part: Callable[[Batch], Iterator[tuple[int, np.ndarray]]], size: int) -> np.ndarray:
    """The vector of ``size`` sums that tasks make: ``part`` gives (first position, numbers) for some episodes, added up in the task first."""

    def add(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in it:
            for piece in pieces(batch, d):
                for at, x in part(Batch(piece, d)):
                    total[at : at + len(x)] += x
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["position", "x"])

    out = np.zeros(size)
    for r in episodes.mapInArrow(add, "position bigint, x double").groupBy("position").agg(F.sum("x").alias("x")).collect():  # the sums alone
        out[r["position"]] = r["x"]
    return out


def behaviour(episodes: DataFrame, d: Design) -> np.ndarray:
    """Removal rates by replicate, fold set and cell: from the folds outside the set, with one removal and one other added."""

    def part(b: Batch):
        row, t = np.nonzero(np.arange(b.a.shape[1]) < b.size[:, None])
        place = b.fold[row] * d.cells + b.cell[row, t]
        for r in range(d.replicates):
            w = b.times[r][row]
            both = np.stack([np.bincount(place, x, d.n_folds * d.cells) for x in (w, w * b.a[row, t])])
            yield r * both.size, both.ravel()

    sums = summed(episodes, d, part, d.replicates * 2 * d.n_folds * d.cells).reshape(d.replicates, 2, d.n_folds, d.cells)
    rest = np.stack([sums.sum(2) - sums[:, :, list(s)].sum(2) for s in d.sets], 2)
    return (rest[:, 1] + 1) / (rest[:, 0] + 2)


def supported(rows: DataFrame, measures: list[str]) -> int:
    """The last period up to which rows at risk of every measure are in three folds or more, so that no pair of folds holds them all."""
    at = rows.groupBy("decision_period").agg(*[F.count_distinct(F.when(F.col(f"risk_{m}") > 0, F.col("fold"))).alias(m) for m in measures])
    r = at.agg(F.min(F.when(F.exists(F.array(*measures), lambda n: n <= 2), F.col("decision_period"))), F.max("decision_period")).first()
    return r[0] - 1 if r[0] is not None else r[1] or 0


def check_support(episodes: DataFrame, d: Design) -> None:
    """Raises where a period that occurs has no rows at risk outside some fold set, for any replicate; before anything is fitted."""

    def part(b: Batch):
        for t in range(b.a.shape[1]):
            rows = np.flatnonzero(b.size > t)
            for r in range(d.replicates):
                for f in range(d.n_folds):
                    here = rows[b.fold[rows] == f]
                    yield ((t * d.replicates + r) * d.n_folds + f) * len(d.measures), ((b.risk[here, t] > 0) * b.times[r][here][:, None]).sum(0)

    n = summed(episodes, d, part, d.stages * d.replicates * d.n_folds * len(d.measures)).reshape(d.stages, d.replicates, d.n_folds, -1)
    rest = np.stack([n.sum(2) - n[:, :, list(s)].sum(2) for s in d.sets], 2)
    lost = sorted({int(t) + 1 for t in np.argwhere((rest <= 0).any(axis=(1, 2, 3)))[:, 0]})
    if lost:
        raise ValueError(f"no training trajectories at decision periods {lost} outside some pair of folds; shorten the horizon. No continuation was fitted")


def auxiliary(episodes: DataFrame, d: Design, g: np.ndarray, stretch: int, record: Callable) -> np.ndarray:
    """Models by replicate, pair and stage, each fitted on the folds outside the pair, last stage first."""
    models, size = np.zeros((d.replicates, len(d.pairs), d.stages, *d.shape)), length(d)
    now, since = episodes, None
    for t in range(d.stages - 1, -1, -1):
        if t < d.stages - 1 and (d.stages - 1 - t) % stretch == 0:
            now, since = cut(with_state(now, d, g, models, t, since)), t + 1

        def part(b: Batch, t=t, since=since):
            for r in range(d.replicates):
                for i, s in enumerate(d.pairs):
                    rows = np.flatnonzero((b.size > t) & ~np.isin(b.fold, d.sets[s]) & (b.times[r] > 0))
                    if len(rows):
                        start = None if since is None else np.stack([b.state[e][r, i] for e in rows])
                        after = b.next_scores(d, t, g[r, s], models[r, i], rows, start, since)
                        yield (r * len(d.pairs) + i) * size, b.moments(d, t, rows, b.r[rows, t][:, None, :] + after, b.times[r][rows])

        began = time.monotonic()
        sums = summed(now, d, part, d.replicates * len(d.pairs) * size).reshape(d.replicates, len(d.pairs), size)
        for r in range(d.replicates):
            for i in range(len(d.pairs)):
                models[r, i, t] = solved(sums[r, i], d)
        record("auxiliary_continuation", t + 1, sums[:, :, 0], time.monotonic() - began)
    return models


def with_state(episodes: DataFrame, d: Design, g: np.ndarray, models: np.ndarray, t: int, since: int | None) -> DataFrame:
    """``episodes`` with ``state``: the scores of stage t + 1 by replicate, pair, policy and measure; zeros where it has none."""
    kept = [c for c in episodes.columns if c != "state"]
    kind = ", ".join(f"{c} {k}" for c, k in episodes.select(*kept).dtypes) + ", state binary"

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in it for piece in pieces(whole, d)):
            b, n = Batch(batch, d), batch.num_rows
            out = np.zeros((n, d.replicates, len(d.pairs), *d.shape[1:]))
            rows = np.flatnonzero(b.size > t + 1)
            for r in range(d.replicates):
                for i, s in enumerate(d.pairs):
                    start = None if since is None else np.stack([b.state[e][r, i] for e in rows]) if len(rows) else None
                    out[rows, r, i] = b.next_scores(d, t, g[r, s], models[r, i], rows, start, since)
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.get_field_index(c)) for c in kept], pa.array([x.tobytes() for x in out], pa.binary())], names=[*kept, "state"])

    return episodes.mapInArrow(each, kind)


def outer(episodes: DataFrame, d: Design, g: np.ndarray, aux: np.ndarray, record: Callable) -> np.ndarray:
    """Models by replicate, fold and stage, fitted on the other folds; a row of fold j takes its next score from the pair's models. One pass for all stages."""
    size = length(d)

    def part(b: Batch):
        for r in range(d.replicates):
            for i, s in enumerate(d.pairs):
                for j, k in (d.sets[s], d.sets[s][::-1]):
                    rows = np.flatnonzero((b.fold == j) & (b.times[r] > 0))
                    after = np.zeros((len(rows), *d.shape[1:]))
                    for t in range(int(b.size[rows].max(initial=0)) - 1, -1, -1):
                        live = np.flatnonzero(b.size[rows] > t)
                        now = rows[live]
                        yield ((r * d.n_folds + k) * d.stages + t) * size, b.moments(d, t, now, b.r[now, t][:, None, :] + after[live], b.times[r][now])
                        after[live] = b.step(d, t, g[r, s], aux[r, i, t], now, after[live])

    began = time.monotonic()
    sums = summed(episodes, d, part, d.replicates * d.n_folds * d.stages * size).reshape(d.replicates, d.n_folds, d.stages, size)
    models = np.zeros((d.replicates, d.n_folds, d.stages, *d.shape))
    for at in np.ndindex(*models.shape[:3]):
        models[at] = solved(sums[at], d)
    seconds = (time.monotonic() - began) / max(1, d.stages)
    for t in range(d.stages):
        record("continuation", t + 1, sums[:, :, t, 0], seconds)
    return models


@dataclass
class Fit:
    """The models, and a record (component, period, fold set, replicate, training rows at risk of the first measure, seconds) of each."""

    design: Design
    g: np.ndarray
    models: np.ndarray
    records: list[tuple]


def prepared(rows: DataFrame, keys: list[str], features: list[str], policies: list[Policy], measures: list[str], n_folds: int, penalty: float, times: DataFrame | None, replicates: int) -> tuple[DataFrame, Design]:
    ship(rows.sparkSession)
    r = rows.agg(F.max("decision_period"), F.max("cell"), *[F.avg(c) for c in features]).first()
    d = Design(policies, measures, n_folds, r[0] or 0, (r[1] if r[1] is not None else -1) + 1, np.array([x or 0.0 for x in r[2:]], float), replicates, penalty)
    return cut(gathered(rows, keys, features, measures, times)), d


def fit(episodes: DataFrame, d: Design, strict: bool = True, stretch: int = 16) -> Fit:
    """All behaviour and continuation models. ``strict`` refuses periods without support; else their continuation is 0."""
    records: list[tuple] = []
    if strict and d.stages:
        check_support(episodes, d)
    began = time.monotonic()
    g = behaviour(episodes, d)
    records.append(("behaviour", None, None, None, None, time.monotonic() - began))

    def record(component: str, period: int, n: np.ndarray, seconds: float) -> None:
        sets = [d.sets[s] for s in d.pairs] if component == "auxiliary_continuation" else d.sets[: d.n_folds]
        records.extend((component, period, "-".join(map(str, sets[i])), r, float(n[r, i]), seconds / n.size) for r, i in np.ndindex(*n.shape))

    aux = auxiliary(episodes, d, g, stretch, record)
    return Fit(d, g, outer(episodes, d, g, aux, record), records)


def stored(f: Fit, spark) -> DataFrame:
    """A fit as a table: its numbers by place, and its records."""
    rows = [(part, i, float(x), None, None, None, None) for part, of in (("g", f.g), ("models", f.models), ("center", f.design.center)) for i, x in enumerate(of.ravel())]
    rows += [(f"record {component}", i, seconds, period, sets, replicate, n) for i, (component, period, sets, replicate, n, seconds) in enumerate(f.records)]
    return spark.createDataFrame(rows, "part string, place bigint, x double, period int, sets string, replicate int, n double")


def restored(table: DataFrame, d: Design) -> Fit:
    g, models = np.zeros((d.replicates, len(d.sets), d.cells)), np.zeros((d.replicates, d.n_folds, d.stages, *d.shape))
    center = np.zeros(len(d.center))
    of, records = {"g": g.reshape(-1), "models": models.reshape(-1), "center": center}, []
    for r in table.collect():  # models, not rows
        if r["part"] in of:
            of[r["part"]][r["place"]] = r["x"]
        else:
            records.append((r["part"].removeprefix("record "), r["period"], r["sets"], r["replicate"], r["n"], r["x"]))
    return Fit(replace(d, center=center), g, models, sorted(records, key=repr))


def cached_fit(rows: DataFrame, episodes: DataFrame, d: Design, features: list[str], folder: str, strict: bool = True) -> Fit:
    """``fit``, read back from ``folder`` if the same rows were fitted there before under the same settings, else fitted and kept."""
    used = ["entity", "fold", "decision_period", "day", "cell", "action_removed", *features, *[f"{x}_{m}" for m in d.measures for x in ("reward", "risk")]]
    contents = checks.content_fingerprint(rows, used).first()["fingerprint"]
    settings = repr((d.policies, d.measures, d.n_folds, d.replicates, d.penalty, features, strict))
    key = sha256(f"{contents};{settings}".encode()).hexdigest()
    return restored(learners.cached(rows.sparkSession, folder, key, lambda: stored(fit(episodes, d, strict), rows.sparkSession)), d)


DETAIL = ("q_keep", "q_remove", "pi", "g", "ratio", "next_score", "score")


def scores(episodes: DataFrame, keys: list[str], f: Fit) -> DataFrame:
    """policy, measure, keys, fold, decision_period, and of each decision q_keep, q_remove, pi, g, ratio, next_score, score. The estimate itself, not replicates."""
    d, kinds = f.design, dict(episodes.dtypes)
    ddl = ", ".join(["policy string", "measure string", *[f"{k} {kinds[k]}" for k in keys], "fold bigint", "decision_period bigint", *[f"{c} double" for c in DETAIL]])
    named = [(p[0], m) for p in d.policies for m in d.measures]

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in it for piece in pieces(whole, d)):
            b = Batch(batch, d)
            for k in range(d.n_folds):
                rows = np.flatnonzero(b.fold == k)
                after = np.zeros((len(rows), *d.shape[1:]))
                for t in range(int(b.size[rows].max(initial=0)) - 1, -1, -1):
                    live = np.flatnonzero(b.size[rows] > t)
                    now, beta, g = rows[live], f.models[0, k, t], f.g[0, k]
                    pi, p, ratio = b.chosen(d, t, g, now)
                    q = b.values(d, t, beta, now)
                    score = b.step(d, t, g, beta, now, after[live])
                    full = [*q, pi[:, :, None], p[:, None, None], ratio[:, :, None], after[live], score]
                    flat = [np.broadcast_to(x, score.shape).ravel() for x in full]
                    after[live] = score
                    take = pa.array(np.repeat(now, len(named)))
                    yield pa.RecordBatch.from_arrays([
                        pa.array([p for p, _ in named] * len(now), pa.string()), pa.array([m for _, m in named] * len(now), pa.string()),
                        *[batch.column(batch.schema.get_field_index(c)).take(take) for c in keys],
                        pa.array(np.full(len(take), k), pa.int64()), pa.array(np.full(len(take), t + 1), pa.int64()), *map(pa.array, flat),
                    ], names=["policy", "measure", *keys, "fold", "decision_period", *DETAIL])

    return episodes.mapInArrow(each, ddl)


def replicate_values(episodes: DataFrame, f: Fit) -> DataFrame:
    """replicate, policy, measure, n, value: mean episode scores by replicate, an episode counting as often as its entity was drawn."""
    d = f.design
    size = d.replicates * (1 + len(d.policies) * len(d.measures))

    def part(b: Batch):
        for r in range(d.replicates):
            for k in range(d.n_folds):
                rows = np.flatnonzero((b.fold == k) & (b.times[r] > 0))
                first = b.next_scores(d, -1, f.g[r, k], f.models[r, k], rows)
                w = b.times[r][rows]
                yield r * size // d.replicates, np.concatenate([[w.sum()], np.einsum("n,npm->pm", w, first).ravel()])

    sums = summed(episodes, d, part, size).reshape(d.replicates, -1)
    data = [(r, p[0], m, int(sums[r, 0]), float(sums[r, 1 + i * len(d.measures) + j] / sums[r, 0])) for r in range(d.replicates) if sums[r, 0] for i, p in enumerate(d.policies) for j, m in enumerate(d.measures)]
    return episodes.sparkSession.createDataFrame(data, "replicate bigint, policy string, measure string, n bigint, value double")


def nested_scores(rows: DataFrame, keys: list[str], features: list[str], policies: list[Policy], measures: list[str], n_folds: int = 5, penalty: float = 1.0, strict: bool = True, stretch: int = 16) -> DataFrame:
    """The scores of every decision under every policy for every measure; see ``gathered`` for the rows. No rows give no scores."""
    episodes, d = prepared(rows, keys, features, policies, measures, n_folds, penalty, None, 1)
    return scores(episodes, keys, fit(episodes, d, strict, stretch))


def nested_bootstrap(rows: DataFrame, keys: list[str], features: list[str], policies: list[Policy], measures: list[str], times: DataFrame, replicates: int, n_folds: int = 5, penalty: float = 1.0, strict: bool = True) -> DataFrame:
    """``replicate_values`` with every behaviour and continuation model fitted anew on the entities drawn. ``times``: entity, array of draws by replicate.

    Copies of an entity stay in its fold, so none is on both sides of a fit."""
    episodes, d = prepared(rows, keys, features, policies, measures, n_folds, penalty, times, replicates)
    return replicate_values(episodes, fit(episodes, d, strict))
