"""Cross-fitted tree ensembles: gradient-boosted trees with a learnt direction for missing values, and extremely randomised trees.

Features become bin numbers once, by cut points at approximate quantiles (of the features alone; labels play no part); a missing value has a bin
of its own and is never imputed. The model of fold k is grown on the other folds, and all folds' models (and all trees of a forest) grow together: a level
is one pass. In it tasks add up their rows' histograms by model, node, feature and bin, Spark sums these, and each node's split is chosen from its
features' bins in a group of bounded size. A split knows the sums of both sides, so leaves need no pass of their own. Splits reach the driver, rows don't.

A split sends missing values to the side that gains more, so missingness itself can be split on. Nodes without a split that gains stay leaves: constant
features give the training mean. Labels are any finite numbers for ``squared`` loss, 0 or 1 for ``logistic``. A null label, or a null fold, is not trained on.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.checkpoints import cut
from chronopanel.shipping import ship

BINS = 32
MISSING = BINS  # the bin of missing values
SPLIT = "node bigint, feature int, bin int, left boolean, g double, h double, left_g double, left_h double, right_g double, right_h double"


@dataclass
class Ensemble:
    """``slots``: (fold left out, tree number) of what grows together. A tree is nodes in heap order: feature (-1: leaf), last bin to the left, missing to the left, value."""

    features: list[str]
    cuts: list[list[float]]
    loss: str
    folds: list[int]
    rate: float = 1.0
    kept: int = 0  # trees whose margins the rows hold
    base: dict[int, float] = field(default_factory=dict)
    trees: dict[int, list[dict[str, np.ndarray]]] = field(default_factory=dict)

    def margins(self, bins: np.ndarray, fold: int, since: int = 0) -> np.ndarray:
        out = np.zeros(len(bins))
        for tree in self.trees[fold][since:]:
            out += self.rate * tree["value"][leaf_of(tree, bins)]
        return out

    def prediction(self, bins: np.ndarray, fold: int) -> np.ndarray:
        m = self.base[fold] + self.margins(bins, fold)
        return 1 / (1 + np.exp(-np.clip(m, -35, 35))) if self.loss == "logistic" else m

    def score(self, rows: DataFrame, out: str, fold: str = "fold") -> DataFrame:
        """``rows`` with the out-of-fold prediction; null for a fold that no model leaves out."""
        known = binned(rows, self.features, self.cuts)

        def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                bins, folds = matrix(batch, len(self.features)), batch.column(batch.schema.get_field_index(fold)).to_pandas()
                y = np.full(batch.num_rows, np.nan)
                for k in self.folds:
                    here = np.flatnonzero(folds == k)
                    y[here] = self.prediction(bins[here], k)
                kept = [i for i, n in enumerate(batch.schema.names) if n != "_bins"]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(y, from_pandas=True)], names=[*[batch.schema.names[i] for i in kept], out])

        return known.mapInArrow(each, ", ".join(f"`{c}` {k}" for c, k in rows.dtypes) + f", `{out}` double")


def leaf_of(tree: dict[str, np.ndarray], bins: np.ndarray, levels: int | None = None) -> np.ndarray:
    feature, at = tree["feature"], np.arange(BINS + 1)
    nodes = np.arange(len(feature))[:, None]
    left = np.where(at == MISSING, tree["left"][:, None], at <= tree["bin"][:, None])
    after = np.where(feature[:, None] < 0, nodes, 2 * nodes + 2 - left).ravel()  # the next node by node and bin
    flat, row, asked = bins.ravel(), np.arange(len(bins)) * bins.shape[1], np.maximum(feature, 0)
    node = np.zeros(len(bins), np.int64)
    for _ in range(levels if levels is not None else len(feature).bit_length() - 1):
        node = after[node * (BINS + 1) + flat[row + asked[node]]]
    return node


def sapling(depth: int) -> dict[str, np.ndarray]:
    n = 2 ** (depth + 1) - 1
    return {"feature": np.full(n, -1), "bin": np.zeros(n, np.int64), "left": np.zeros(n, bool), "value": np.zeros(n)}


def cut_points(rows: DataFrame, features: list[str]) -> list[list[float]]:
    """At most BINS - 1 increasing cut points for each feature: a value belongs to the first bin whose cut point isn't below it."""
    shares = [k / BINS for k in range(1, BINS)]
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    r = rows.agg(*[F.percentile_approx(finite(c), shares, 10_000).alias(f"q{i}") for i, c in enumerate(features)]).first()
    return [sorted(set(q or [])) for q in r]


def binned(rows: DataFrame, features: list[str], cuts: list[list[float]]) -> DataFrame:
    """``rows`` with ``_bins``: a byte for each feature."""

    def one(c: str, at: list[float]):
        x = F.col(c).cast("double")
        below = F.size(F.filter(F.array(*[F.lit(float(v)) for v in at]), lambda v: v < x)) if at else F.lit(0)
        return F.when(x.isNull() | F.isnan(x), F.lit(MISSING)).otherwise(below)

    return rows.withColumn("_bins", F.unhex(F.concat(*[F.lpad(F.hex(one(c, at).cast("bigint")), 2, "0") for c, at in zip(features, cuts, strict=True)])))


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("_bins")).to_pylist()), np.uint8).reshape(-1, width)


def best_split(n: np.ndarray, g: np.ndarray, h: np.ndarray, penalty: float, least: float, pick: int | None = None) -> tuple[float, int, bool]:
    """(gain, last bin to the left, missing to the left) of one feature's bins, missing ones last; -inf if none leaves ``least`` rows on both sides.

    ``pick``: the only cut to look at, instead of all."""
    worth = lambda g, h: g * g / (h + penalty)
    best = (-np.inf, 0, False)
    for left in (True, False):
        extra = [x[-1] if left else 0.0 for x in (n, g, h)]
        ln, lg, lh = (np.cumsum(x[:-1]) + e for x, e in zip((n, g, h), extra, strict=True))
        rn, rg, rh = (x.sum() - y for x, y in zip((n, g, h), (ln, lg, lh), strict=True))
        gain = np.where((ln >= least) & (rn >= least), worth(lg, lh) + worth(rg, rh) - worth(g.sum(), h.sum()), -np.inf)
        at = int(gain.argmax()) if pick is None else pick
        if gain[at] > best[0]:
            best = (float(gain[at]), at, left)
    return best


def hashed(*parts: int) -> int:
    return xxhash.xxh64_intdigest(b"".join(int(p).to_bytes(8, "little", signed=True) for p in parts))


def level(data: DataFrame, e: Ensemble, slots: list[tuple[int, int]], growing: dict, depth: int, penalty: float, least: float, seed: int | None) -> list:
    """The splits and sums of all nodes of one level of all slots, from one pass. With a ``seed`` each feature's cut is drawn, not searched."""
    width, logistic = len(e.features), e.loss == "logistic"

    def histograms(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        size, first = 2**depth * (BINS + 1), 2**depth - 1
        for batch in it:
            bins, folds, y = matrix(batch, width), batch.column(batch.schema.get_field_index("_fold")).to_numpy(), batch.column(batch.schema.get_field_index("_y")).to_numpy()
            margin = batch.column(batch.schema.get_field_index("_margin")).flatten().to_numpy().reshape(batch.num_rows, -1)
            done: dict[int, tuple] = {}
            for s, (k, _) in enumerate(slots):
                if k not in done:  # the slots of a fold share rows and gradients
                    rows = np.flatnonzero(folds != k)
                    mine = bins[rows]
                    m = e.base[k] + margin[rows, e.folds.index(k)] + (e.margins(mine, k, e.kept) if seed is None else 0.0)
                    p = 1 / (1 + np.exp(-np.clip(m, -35, 35))) if logistic else m
                    done[k] = mine, mine.T.astype(np.int64), p - y[rows], p * (1 - p) if logistic else np.ones(len(rows))
                mine, columns, g, h = done[k]
                if depth:
                    node = leaf_of(growing[s], mine, depth) - first
                    live = np.flatnonzero(node >= 0)
                    node, columns, g, h = node[live] * (BINS + 1), columns[:, live], g[live], h[live]
                else:
                    node = 0
                hist = total.setdefault(s, np.zeros((width, size, 3)))
                for f in range(width):
                    b = columns[f] + node
                    for i, w in enumerate((None, g, h)):
                        hist[f, :, i] += np.bincount(b, w, size)
        for s, hist in total.items():
            f, at = np.nonzero(hist[:, :, 0])
            part = hist[f, at]
            yield pa.RecordBatch.from_arrays([pa.array((s << 32) + first + at // (BINS + 1)), pa.array(f.astype(np.int32)), pa.array((at % (BINS + 1)).astype(np.int32)), *[pa.array(part[:, i]) for i in range(3)]], names=["node", "feature", "bin", "n", "g", "h"])

    names_of_split = [c.split(" ")[0] for c in SPLIT.split(", ")]

    def choose(of: pd.DataFrame) -> pd.DataFrame:
        node = int(of["node"].iloc[0])
        hist = np.zeros((width, BINS + 1, 3))
        hist[of["feature"], of["bin"]] = of[["n", "g", "h"]]
        _, g, h = hist[0].sum(0)
        names = range(width)
        if seed is not None:  # about the root of their number, at random
            names = sorted(names, key=lambda f: hashed(seed, node, f))[: max(1, round(width**0.5))] if e.loss == "logistic" else names
        best = (-np.inf, 0, False, -1)
        for f in names:
            pick, seen = None, np.flatnonzero(hist[f, :-1, 0])
            if seed is not None:
                low, high = (int(seen[0]), int(seen[-1])) if len(seen) else (0, 0)
                pick = low + hashed(seed, node, f, 1) % max(1, high - low)
            found = best_split(*hist[f].T, penalty, least, pick)
            if found[0] > best[0]:
                best = (*found, f)
        if best[0] <= 1e-9:
            return pd.DataFrame([(node, -1, 0, False, g, h, 0.0, 0.0, 0.0, 0.0)], columns=names_of_split)
        to_left = np.append(np.arange(BINS) <= best[1], best[2])
        sides = [hist[best[3]][side].sum(0)[1:] for side in (to_left, ~to_left)]
        return pd.DataFrame([(node, best[3], best[1], best[2], g, h, *sides[0], *sides[1])], columns=names_of_split)

    sums = data.mapInArrow(histograms, "node bigint, feature int, bin int, n double, g double, h double").groupBy("node", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ngh"])
    return sums.groupBy("node").applyInPandas(choose, SPLIT).collect()  # a row for each node


def grow(data: DataFrame, e: Ensemble, slots: list[tuple[int, int]], depth: int, penalty: float, least: float, seed: int | None) -> list[dict[str, np.ndarray]]:
    trees = [sapling(depth) for _ in slots]
    for d in range(max(1, depth)):
        for r in level(data, e, slots, trees, d, penalty, least, seed):
            tree, node = trees[r["node"] >> 32], r["node"] & (2**32 - 1)
            tree["value"][node] = -r["g"] / (r["h"] + penalty)
            if depth and r["feature"] >= 0:
                tree["feature"][node], tree["bin"][node], tree["left"][node] = r["feature"], r["bin"], r["left"]
                for child, side in ((2 * node + 1, "left"), (2 * node + 2, "right")):
                    tree["value"][child] = -r[f"{side}_g"] / (r[f"{side}_h"] + penalty)
    return trees


def started(rows: DataFrame, features: list[str], label: str, fold: str, loss: str, rate: float) -> tuple[DataFrame, Ensemble]:
    ship(rows.sparkSession)
    known = rows.where(F.col(label).isNotNull() & F.col(fold).isNotNull())
    cuts = cut_points(known, features)
    sums = {r[0]: (r[1], r[2]) for r in known.groupBy(fold).agg(F.count("*"), F.sum(F.col(label).cast("double"))).collect()}  # a row for each fold
    e = Ensemble(features, cuts, loss, sorted(sums), rate)
    for k in e.folds:
        n, y = (sum(x[i] for j, x in sums.items() if j != k) for i in (0, 1))
        if not n:
            raise ValueError("the training part of a fold is empty")
        mean = y / n
        smooth = (y + 1) / (n + 2)
        e.base[k], e.trees[k] = float(np.log(smooth / (1 - smooth))) if loss == "logistic" else mean, []
    data = binned(known, features, cuts).select(F.col(fold).cast("int").alias("_fold"), F.col(label).cast("double").alias("_y"), "_bins", F.array_repeat(F.lit(0.0), len(e.folds)).alias("_margin"))
    return cut(data), e


def with_margins(data: DataFrame, e: Ensemble) -> DataFrame:
    """``data`` with the margins of all trees so far, so that later trees needn't read them."""

    def each(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            bins, at = matrix(batch, len(e.features)), batch.schema.get_field_index("_margin")
            m = batch.column(at).flatten().to_numpy().reshape(batch.num_rows, -1) + np.stack([e.margins(bins, k, e.kept) for k in e.folds], 1)
            yield batch.set_column(at, "_margin", pa.array(list(m)))

    return cut(data.mapInArrow(each, data.schema))


def boosted(rows: DataFrame, features: list[str], label: str, loss: str = "logistic", trees: int = 20, depth: int = 3, rate: float = 0.2, penalty: float = 1.0, least: float = 1.0, fold: str = "fold", stretch: int = 8) -> Ensemble:
    """Gradient boosting, a tree after the other, with the gradients and curvatures of the loss."""
    data, e = started(rows, features, label, fold, loss, rate)
    for t in range(trees if len(e.folds) > 1 else 0):
        if t and t % stretch == 0:
            data = with_margins(data, e)
            e.kept = t
        slots = [(k, t) for k in e.folds]
        for (k, _), tree in zip(slots, grow(data, e, slots, depth, penalty, least, None), strict=True):
            e.trees[k].append(tree)
    return e


def extra(rows: DataFrame, features: list[str], label: str, loss: str = "squared", trees: int = 25, depth: int = 5, least: float = 5.0, seed: int = 42, fold: str = "fold") -> Ensemble:
    """Extremely randomised trees: a node's cut of each feature is drawn by hash between the node's own least and greatest bin, and the best feature taken.

    Means of leaves are averaged over the trees; with ``loss="logistic"`` for 0/1 labels only some features are tried at a node. All trees of all folds grow together."""
    data, e = started(rows, features, label, fold, loss, 1.0 / trees)
    e.loss = "squared"  # leaves hold mean residuals whatever the label
    means = {k: (1 / (1 + np.exp(-b)) if loss == "logistic" else b) for k, b in e.base.items()}
    e.base = means
    slots = [(k, t) for k in e.folds for t in range(trees)]
    grown = grow(data, e, slots, depth, 1e-9, least, seed)
    for (k, _), tree in zip(slots, grown, strict=True):
        e.trees[k].append(tree)
    return e
