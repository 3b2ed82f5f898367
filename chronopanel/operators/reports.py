"""Whole tables about a panel and its predictions: policy diagnostics, overviews, one row for each episode, durations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronopanel.functions.time import DAY
from chronopanel.operators import ranges


def with_durations(rows: DataFrame, start: str, end: str, most_days: float = 7.0) -> DataFrame:
    """``rows`` with ``duration_days`` and ``long_duration`` (1 above ``most_days``; 0 also where a bound is missing)."""
    days = (F.col(end) - F.col(start)) / float(DAY)
    return rows.select("*", days.alias("duration_days"), F.coalesce(days > most_days, F.lit(False)).cast("int").alias("long_duration"))


def _n(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("bigint")


def policy_diagnostics(rows: DataFrame, predictions: list[str], episode: list[str], entity: str = "entity") -> DataFrame:
    """One row for each policy: how its rows, removals, durations and predictions look, and what is wrong with them.

    ``rows``: policy, policy_day (null: observed practice), the episode's columns, episode_day, policy_state, policy_action, extra_row_out, duration_days,
    long_duration, and ``p_<name>`` for each prediction. A policy's removals must be one for each episode that reaches its day
    (``n_removal_shortfall`` is what lacks; null for observed practice), its days must not repeat (all rows of a repeated day count), and an episode must not be in longer than
    the policy allows. ``complete`` episodes have every prediction on every row; exposure is the duration of rows inside.

    The rows are shuffled once, by policy and episode; days, episodes and policies are then summed from what is smaller each time.
    """
    inside, p = F.col("policy_state") == "in", {k: F.col(f"p_{k}") for k in predictions}
    sums = {
        "n_rows": F.lit(1).cast("bigint"),
        "n_in_rows": _n(inside),
        "n_out_rows": _n(F.col("policy_state") == "out"),
        "n_remove_rows": _n(F.col("policy_action") == "remove"),
        "n_extra_rows_out": F.coalesce(F.col("extra_row_out").cast("bigint"), F.lit(0).cast("bigint")),
        "n_bad_durations": _n(~F.coalesce(F.col("duration_days") > 0, F.lit(False))),
        "n_long_durations": F.col("long_duration").cast("bigint"),
        **{f"n_missing_{k}": _n(c.isNull()) for k, c in p.items()},
        **{f"n_{k}_below_0": _n(c < 0) for k, c in p.items()},
        **{f"n_{k}_above_1": _n(c > 1) for k, c in p.items()},
    }
    bounds = [f(c).alias(f"{n}_{k}") for k, c in p.items() for f, n in ((F.min, "least"), (F.max, "most"))]
    again = [f(f"{n}_{k}").alias(f"{n}_{k}") for k in predictions for f, n in ((F.min, "least"), (F.max, "most"))]
    key = ["policy", "policy_day", *episode]
    lacks = [F.col(f"n_missing_{k}") for k in predictions]
    days = rows.repartition("policy", *episode).groupBy(*key, "episode_day").agg(*[F.sum(c).alias(k) for k, c in sums.items()], *bounds, F.sum(F.when(inside, F.col("duration_days")).otherwise(0.0)).alias("days_in"))
    eps = days.groupBy(*key).agg(
        *[F.sum(k).alias(k) for k in sums],
        *again,
        F.sum("days_in").alias("days_in"),
        F.sum(F.when(F.col("n_rows") > 1, F.col("n_rows")).otherwise(0)).alias("n_repeated_day_rows"),
        F.max(_n(F.col("episode_day") == F.col("policy_day"))).alias("reaches"),
    )
    complete = sum(lacks, F.lit(0)) == 0
    out = eps.groupBy("policy", "policy_day").agg(
        F.count("*").alias("n_episodes"),
        F.count_distinct(entity).alias("n_entities"),
        *[F.sum(k).alias(k) for k in sums],
        *again,
        F.sum("reaches").alias("n_episodes_reaching_day"),
        F.count_if(F.col("n_remove_rows") > 1).alias("n_episodes_several_removals"),
        F.sum("n_repeated_day_rows").alias("n_repeated_day_rows"),
        F.count_if(F.col("n_in_rows") > F.col("policy_day")).alias("n_episodes_in_too_long"),
        F.count_if(complete).alias("n_complete_episodes"),
        F.count_if(~complete).alias("n_incomplete_episodes"),
        F.avg("n_in_rows").alias("mean_in_rows"),
        F.avg("days_in").alias("mean_exposure_days"),
    )
    total = lambda end: sum((F.col(f"n_{k}_{end}") for k in predictions), F.lit(0).cast("bigint"))
    return out.select(
        "*",
        F.when(F.col("policy_day").isNull(), "observed").otherwise("fixed_day").alias("policy_type"),
        F.when(F.col("policy_day").isNotNull(), F.col("n_episodes_reaching_day") - F.col("n_remove_rows")).alias("n_removal_shortfall"),
        total("below_0").alias("n_predictions_below_0"),
        total("above_1").alias("n_predictions_above_1"),
    )


def cohort_overview(rows: DataFrame, stay: list[str], episode: list[str], missing: str, order: list[str], entity: str = "entity") -> DataFrame:
    """One row: rows, entities, those whose first row (by ``order``) lacks ``missing``, stays and episodes."""
    first = F.min_by(F.struct(F.col(missing).isNull().alias("lacks")), F.struct(*order)).alias("first")
    eps = rows.groupBy(*dict.fromkeys([entity, *stay, *episode])).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("_at"), first)
    people = eps.groupBy(entity).agg(F.sum("n").alias("n"), F.count_distinct(F.struct(*stay)).alias("stays"), F.count_distinct(F.struct(*episode)).alias("episodes"), F.min_by("first.lacks", "_at").alias("lacks"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint"))
    return people.agg(zero(F.sum("n")).alias("n_rows"), F.count("*").alias("n_entities"), F.count_if("lacks").alias(f"n_entities_missing_{missing}"), zero(F.sum("stays")).alias("n_stays"), zero(F.sum("episodes")).alias("n_episodes"))


def state_overview(rows: DataFrame, episode: list[str], entity: str = "entity", state: str = "state") -> DataFrame:
    """For each state, a missing one too: rows, entities, episodes. Counted by episode first, so no task holds a state."""
    eps = rows.groupBy(state, *dict.fromkeys([entity, *episode])).agg(F.count("*").alias("n"))
    return eps.groupBy(state, entity).agg(F.sum("n").alias("n"), F.count("*").alias("episodes")).groupBy(state).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_entities"), F.sum("episodes").alias("n_episodes"))


def event_overview(rows: DataFrame, sets: dict[str, tuple[Column, str]]) -> DataFrame:
    """analysis_set, n_rows, events, event_rate: for each named (rows counted, flag), from one pass. No rows: 0 events and a null rate."""
    one = rows.agg(*[F.struct(F.count_if(m).alias("n"), F.coalesce(F.sum(F.when(m, F.col(y).cast("bigint"))), F.lit(0).cast("bigint")).alias("e"), F.avg(F.when(m, F.col(y).cast("double"))).alias("r")).alias(k) for k, (m, y) in sets.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("analysis_set"), F.col(f"{k}.n").alias("n_rows"), F.col(f"{k}.e").alias("events"), F.col(f"{k}.r").alias("event_rate")) for k in sets])).alias("s")).select("s.*")


def counts(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """metric, value: how many rows meet each condition, from one pass."""
    one = rows.agg(*[F.count_if(c).alias(k) for k, c in conditions.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in conditions])).alias("s")).select("s.*")


def episode_level(
    rows: DataFrame, episode: list[str], age: str, decision_feature: str, binary_feature: str, risk_feature: str, reinsertion_feature: str, late: int = 7, split: bool = False, entity: str = "entity"
) -> DataFrame:
    """One row for each episode with a period inside, for tests between episodes.

    entity, ``age`` and ``binary_feature`` (first known value by period), ``exposure_days`` and ``in_periods`` of rows inside, ``late_removal`` (that many periods or more), ``any_outcome``, ``any_reinsertion``,
    and medians of known values: ``decision_feature`` over decisions, ``risk_feature`` over rows at risk of the outcome, ``reinsertion_feature`` over those at risk of reinsertion (null without any).
    Missing flags are 0. ``split`` adds the median age of all episodes, those without a period inside too, and whether the episode's reaches it (null where unknown).
    An episode's rows are few, so its medians are Spark's; that of all episodes goes through ranges.
    """
    at = F.struct("period_end", "episode_index")
    first = lambda c: F.min_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), at))
    inside = F.col("state") == "in"
    over = lambda c, m: F.median(F.when(m, F.col(c).cast("double")))
    zero_one = lambda c: F.greatest(F.least(F.coalesce(c.cast("int"), F.lit(0)), F.lit(1)), F.lit(0))
    keys = list(dict.fromkeys([entity, *episode]))
    out = rows.groupBy(*keys).agg(
        first(age).cast("double").alias(age),
        (F.sum(F.when(inside, F.col("interval_hours"))) / 24).alias("exposure_days"),
        F.max(F.when(inside, F.col("periods_in_state"))).alias("in_periods"),
        zero_one(F.max(F.when(inside, F.col("periods_in_state"))) >= late).alias("late_removal"),
        zero_one(F.max("outcome_in")).alias("any_outcome"),
        zero_one(F.max("reinsertion_in")).alias("any_reinsertion"),
        over(decision_feature, F.col("is_decision")).alias(f"decision_{decision_feature}"),
        zero_one(first(binary_feature)).alias(binary_feature),
        over(risk_feature, F.col("at_risk_outcome") == 1).alias(f"risk_{risk_feature}"),
        over(reinsertion_feature, F.col("at_risk_reinsertion") == 1).alias(f"reinsertion_{reinsertion_feature}"),
    )
    if split:
        middle = ranges.quantiles(out.select(F.lit(0).alias("_all"), age), ["_all"], age, [0.5]).select(F.col("q")[0].alias(f"{age}_median"))
        one = middle.agg(F.max(f"{age}_median").alias(f"{age}_median"))  # one row, also where no age is known
        out = out.crossJoin(F.broadcast(one)).withColumn(f"{age}_ge_median", (F.col(age) >= F.col(f"{age}_median")).cast("double"))
    return out.where("exposure_days IS NOT NULL")


def last_weights(rows: DataFrame, keys: list[str], ratio: str = "ratio") -> DataFrame:
    """keys, n_steps, weight: each trajectory's number of steps and product of ratios."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_steps"), F.product(ratio).alias("weight"))
