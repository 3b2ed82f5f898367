"""Leakage-safe features from time-stamped measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.functions.time import DAY, floor_div
from chronopanel.operators import ranges

STATS = ("count", "mean", "std", "last", "slope_per_hour")


def fit_rules(values: DataFrame, item: str = "item", value: str = "value", least: int = 100, most_zeros: float = 0.10, spread: float = 3.0) -> DataFrame:
    """A cleaning rule for each item, from exact quantiles.

    Zeros count as missing where there are at least ``least`` values, the 5th percentile of the others is positive and zeros are
    at most ``most_zeros`` of all. Values are clipped to the 1st and 99th percentile, and deleted beyond those by more
    than ``spread`` times the larger of the quartile range and the range of the two. Rules on too few values aren't applied.
    """
    v = F.col(value)
    first = values.where(v.isNotNull()).groupBy(item).agg(
        F.count("*").alias("n_values"),
        F.avg((v == 0).cast("double")).alias("zero_fraction"),
    )
    low = ranges.quantiles(values.where(v != 0), [item], value, [0.05])
    first = first.join(low, item, "left").withColumn("p5_nonzero", F.col("q")[0]).drop("q")
    zero = F.coalesce((F.col("n_values") >= least) & (F.col("p5_nonzero") > 0) & (F.col("zero_fraction") > 0) & (F.col("zero_fraction") <= most_zeros), F.lit(False))
    marked = first.withColumn("zero_to_missing", zero)
    used = values.where(v.isNotNull()).join(marked.select(item, "zero_to_missing"), item).where(~(F.col("zero_to_missing") & (v == 0)))
    cuts = used.groupBy(item).agg(F.count("*").alias("n_used")).join(ranges.quantiles(used, [item], value, [0.01, 0.25, 0.75, 0.99]), item)
    joined = marked.join(cuts, item, "left")
    p1, q1, q3, p99 = (F.col("q")[k] for k in range(4))
    width = F.greatest(F.coalesce(F.greatest(q3 - q1, p99 - p1), F.lit(0.0)), F.lit(1e-8))
    status = F.when(F.coalesce("n_used", F.lit(0)) >= least, "ok").otherwise("too_few_values")
    return joined.select(item, "n_values", "zero_fraction", "p5_nonzero", "zero_to_missing", F.coalesce("n_used", F.lit(0)).alias("n_used"), p1.alias("low_clip"), p99.alias("high_clip"), (p1 - spread * width).alias("low_delete"), (p99 + spread * width).alias("high_delete"), status.alias("status"))


def apply_rules(values: DataFrame, rules: DataFrame, item: str = "item", value: str = "value") -> DataFrame:
    """``values`` cleaned: what a rule deletes goes (zeros first, then far values), the rest is clipped. Items without a rule in force stay as they are."""
    v = F.col(value)
    known = values.join(rules.select(item, "zero_to_missing", "low_clip", "high_clip", "low_delete", "high_delete", (F.col("status") == "ok").alias("active")), item, "left")
    active = F.coalesce("active", F.lit(False))
    gone = active & ((F.col("zero_to_missing") & (v == 0)) | (v < F.col("low_delete")) | (v > F.col("high_delete")))
    clean = F.when(gone, None).when(active, F.least(F.greatest(v, F.col("low_clip")), F.col("high_clip"))).otherwise(v)
    return known.withColumn(value, clean).where(F.col(value).isNotNull()).select(*values.columns)


def in_extraction_windows(events: DataFrame, windows: DataFrame, entity: str = "entity") -> DataFrame:
    """Events in [start, end) of a window of the same entity; windows must not overlap (merge them first)."""
    w = windows.select(F.col(entity).alias("_e"), F.col("start").alias("_s"), F.col("end").alias("_t"))
    return events.join(w, (F.col(entity) == F.col("_e")) & (F.col("t") >= F.col("_s")) & (F.col("t") < F.col("_t"))).select(*events.columns)


def to_celsius(item: Column, unit: Column, value: Column, units: tuple[str, ...], items: tuple) -> Column:
    """A value with Fahrenheit units or items converted; null units are none."""
    hot = F.upper(F.trim(F.coalesce(unit, F.lit("")))).isin(*units) | item.isin(*items)
    return F.when(hot, (value - 32) * 5 / 9).otherwise(value)


def normalised_units(rows: DataFrame, units: tuple[str, ...], hot_items: tuple, as_item, as_unit: str, kept: tuple, item: str = "item", unit: str = "unit", value: str = "value") -> DataFrame:
    """``rows`` with Fahrenheit ones (by unit or by item) rewritten: their value converted, their item and unit those of Celsius. Then only the ``kept`` items stay.

    So a Fahrenheit item need not be kept itself, and an item that became the Celsius one stays only if that is kept. ``was_converted`` marks rewritten rows; a missing value stays missing.
    """
    hot = F.upper(F.trim(F.coalesce(F.col(unit), F.lit("")))).isin(*units) | F.coalesce(F.col(item).isin(*hot_items), F.lit(False))
    put = {value: F.when(hot, (F.col(value) - 32) * (5.0 / 9.0)).otherwise(F.col(value)), item: F.when(hot, F.lit(as_item)).otherwise(F.col(item)), unit: F.when(hot, F.lit(as_unit)).otherwise(F.col(unit))}
    return rows.select(*[put[c].alias(c) if c in put else F.col(c) for c in rows.columns], hot.alias("was_converted")).where(F.col(item).isin(*kept))


def lookback(events: DataFrame, panel: DataFrame, period: int = DAY) -> DataFrame:
    """Statistics of each item in each panel row's look-back [max(unit_in, period_start - period), period_start).

    The look-backs of an episode's periods tile the line, so an event belongs to the row with index floor((t - inserted) / period) + 1 and
    the join is an equality on (entity, inserted, index), not a range. An event of an entity meets each of its
    episodes once. ``panel``: entity, inserted, episode_index, period_start, look_start; ``events``: entity, item, t, value.
    """
    eps = panel.select("entity", "inserted").distinct()
    placed = events.join(eps, "entity").withColumn("episode_index", floor_div(F.col("t") - F.col("inserted"), period) + 1)
    keyed = placed.join(panel.select("entity", "inserted", "episode_index", "period_start", "look_start"), ["entity", "inserted", "episode_index"])
    inside = keyed.where((F.col("t") >= F.col("look_start")) & (F.col("t") < F.col("period_start")))
    hours = (F.col("t") - F.col("period_start")) / F.lit(3.6e9)
    return inside.groupBy("entity", "inserted", "episode_index", "item").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.max_by("value", F.struct("t", "value")).alias("last"),
        F.regr_slope("value", hours).alias("slope_per_hour"),
    )


def retention(stats: DataFrame, panel: DataFrame, row_share: float = 0.05, entity_share: float = 0.10) -> DataFrame:
    """For each item and statistic: in how many rows and entities it is known, the shares, and whether to retain it."""
    totals = panel.agg(F.count("*").alias("all_rows"), F.count_distinct("entity").alias("all_entities"))
    long = stats.select("entity", "item", F.explode(F.array(*[F.struct(F.lit(s).alias("stat"), F.col(s).cast("double").alias("x")) for s in STATS])).alias("s")).select("entity", "item", "s.stat", "s.x")
    known = long.where("x IS NOT NULL").groupBy("item", "stat").agg(F.count("*").alias("n_rows"), F.count_distinct("entity").alias("n_entities"))
    rows, entities = F.col("n_rows") / F.col("all_rows"), F.col("n_entities") / F.col("all_entities")
    decision = F.when((rows >= row_share) & (entities >= entity_share), "retain").otherwise("drop")
    return known.crossJoin(F.broadcast(totals)).select("item", "stat", "n_rows", rows.alias("row_coverage"), "n_entities", entities.alias("entity_coverage"), decision.alias("decision"))


def wide(panel: DataFrame, stats: DataFrame, kept: list[tuple[str, str]]) -> DataFrame:
    """``panel`` with a column ``item__stat`` for each kept pair, rounded to 3 places half to even, and ``…__missing`` flags."""
    key = ["entity", "inserted", "episode_index"]
    columns = [F.max(F.when(F.col("item") == i, F.bround(F.col(s).cast("double"), 3))).alias(f"{i}__{s}") for i, s in kept]
    joined = panel.join(stats.groupBy(*key).agg(*columns), key, "left") if columns else panel
    return joined.select("*", *[F.col(f"{i}__{s}").isNull().cast("int").alias(f"{i}__{s}__missing") for i, s in kept])
