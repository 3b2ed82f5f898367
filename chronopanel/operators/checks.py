"""Checks that refuse bad input: conditions counted in one aggregate, reported as a row or raised."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bad_probability(x: str | Column) -> Column:
    """Missing, not a number, infinite, or outside [0, 1]."""
    x = F.col(x) if isinstance(x, str) else x
    return x.isNull() | F.isnan(x) | (x < 0) | (x > 1)


def bad_flag(x: str | Column) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return ~F.coalesce(x.cast("double").isin(0.0, 1.0), F.lit(False))


def infinite(x: str | Column) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.abs(x) == float("inf"), F.lit(False))


def violations(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row: for each condition, how many rows meet it."""
    return rows.agg(*[F.count_if(c).alias(k) for k, c in conditions.items()])


def require(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """``rows``, or ValueError that names the conditions that rows meet and how many do."""
    found = {k: n for k, n in violations(rows, conditions).first().asDict().items() if n}
    if found:
        raise ValueError(f"invalid rows: {found}")
    return rows


def require_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    n = rows.groupBy(*keys).count().where(F.col("count") > 1).count()
    if n:
        raise ValueError(f"{n} keys of {keys} occur more than once")
    return rows


def attached(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A join that must match one to one; raises where keys repeat on either side or a left row has no match."""
    require_unique(left, keys)
    require_unique(right, keys)
    lost = left.join(right, keys, "left_anti").count()
    if lost:
        raise ValueError(f"{lost} rows have no match by {keys}")
    return left.join(right, keys, "left")


def no_truth_columns(columns: Iterable[str], prefixes: tuple[str, ...] = ("true_", "latent_", "counterfactual_")) -> None:
    """Known truth must not reach a model's input."""
    found = [c for c in columns if c.startswith(prefixes)]
    if found:
        raise ValueError(f"columns that hold the truth: {found}")


def state_features(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """The allowed columns alone, all of which must be there; infinite values are refused, missing ones stay."""
    missing = [c for c in allowed if c not in rows.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")
    return require(rows.select(*allowed), {c: infinite(F.col(c).cast("double")) for c in allowed})


def source_panel(rows: DataFrame, flags: list[str], states: tuple[str, ...] = ("in", "out"), confounders: list[str] | None = None) -> DataFrame:
    """A panel fit to simulate from: no repeated columns, known states, binary flags, at least two confounders with values."""
    repeated = {c for c in rows.columns if rows.columns.count(c) > 1}
    if repeated:
        raise ValueError(f"repeated columns: {sorted(repeated)}")
    if confounders is not None:
        seen = rows.agg(*[F.count(c).alias(c) for c in confounders]).first().asDict() if confounders else {}
        if sum(n > 0 for n in seen.values()) < 2:
            raise ValueError("fewer than two confounders were observed")
    return require(rows, {"unknown_state": ~F.coalesce(F.col("state").isin(*states), F.lit(False)), **{f"bad_{c}": bad_flag(c) for c in flags}})


def decision_faults(panel: DataFrame, episode: list[str], horizon: int | None = None) -> DataFrame:
    """Counts that must be zero before decisions are linked: broken grids, decisions after an exit, rows beyond a horizon; and episodes with several or no last decisions."""
    w = Window.partitionBy(*episode).orderBy("episode_index")
    last = F.col("is_decision") & ~F.coalesce(F.lead("is_decision").over(w), F.lit(False))
    seen = panel.select("*", F.lag("episode_index").over(w).alias("_before"), F.lag("is_decision").over(w).alias("_was"), F.lag("period_end").over(w).alias("_end"), last.alias("_last"))
    beyond = F.col("is_decision") & (F.col("episode_index") >= horizon) if horizon else F.lit(False)
    grid = violations(
        seen,
        {
            "broken_index": F.col("episode_index") != F.coalesce(F.col("_before") + 1, F.lit(0)),
            "gaps": F.coalesce(F.col("_end") != F.col("period_start"), F.lit(False)),
            "decision_after_exit": F.coalesce(F.col("is_decision") & ~F.col("_was"), F.lit(False)),
            "starts_outside": F.col("_before").isNull() & ~F.col("is_decision"),
            "beyond_horizon": beyond,
        },
    )
    ends = violations(seen.groupBy(*episode).agg(F.count_if("_last").alias("n")), {"no_last_decision": F.col("n") == 0, "several_last_decisions": F.col("n") > 1})
    return grid.crossJoin(F.broadcast(ends))  # one row each


def parsed_boolean(x: Column) -> Column:
    """true, yes, t, y, 1 and their opposites in any case with white space around; anything else is null."""
    low = F.lower(F.trim(x))
    return F.when(low.isin("true", "yes", "t", "y", "1", "1.0"), True).when(low.isin("false", "no", "f", "n", "0", "0.0"), False)


def one_hot(column: str, levels: list[str], prefix: str | None = None) -> list[Column]:
    """A 0 or 1 for each of the given levels; a missing or other value has none."""
    return [F.coalesce((F.col(column) == v).cast("int"), F.lit(0)).alias(f"{prefix or column}_{v}") for v in levels]


def named_like(df: DataFrame, *patterns: str) -> list[str]:
    """Columns whose name matches one of the patterns in full, in the order of the table."""
    return [c for c in df.columns if any(re.fullmatch(p, c) for p in patterns)]


def blanked(df: DataFrame, *patterns: str) -> DataFrame:
    """The columns whose name matches are null for all rows, with their types: a panel without these confounders."""
    gone = set(named_like(df, *patterns))
    return df.select(*[F.lit(None).cast(t).alias(c) if c in gone else F.col(c) for c, t in df.dtypes])


def content_fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row, ``fingerprint``: the same for the same rows in any order and partitioning, other for other contents; ``n``: the rows.

    Fields are told apart by their lengths and nulls by a mark of their own, so different rows have different encodings. Hashes of rows are added in
    four parts of 60 bits; names and types of the columns count too.
    """
    kinds = dict(rows.dtypes)
    text = lambda c: F.base64(c) if kinds[c] == "binary" else F.to_json(F.struct(c)) if kinds[c].startswith(("array", "map", "struct")) else F.col(c).cast("string")
    row = F.concat(*[F.coalesce(F.concat(F.length(text(c)).cast("string"), F.lit(":"), text(c)), F.lit("n")) for c in columns])
    digest = F.sha2(row, 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring(digest, 15 * i + 1, 15), 16, 10).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string") for i in range(4)]
    head = F.lit(",".join(f"{len(c)}:{c}:{kinds[c]}" for c in columns))
    return rows.agg(F.sha2(F.concat_ws(";", head, F.count("*").cast("string"), *parts), 256).alias("fingerprint"), F.count("*").alias("n"))
