"""Semi-synthetic outcomes with known truth on an observed grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.stats import any_event, expit, uniform
from chronopanel.functions.time import DAY

EPISODE = ["entity", "inserted"]
# Coefficients and bounds of the simulation.
ACTION_COEFFICIENTS, ACTION_LOW, ACTION_HIGH = (0.45, 0.70, 0.80), 0.05, 0.95
OUTCOME_INTERCEPT, OUTCOME_COEFFICIENTS, TREATMENT = -2.40, (0.40, 0.55, 0.75), -0.90


def standardised(rows: DataFrame, columns: list[str]) -> DataFrame:
    """``z1``.. : each column less its mean over its population standard deviation, missing values at the mean; 0 where it doesn't vary."""
    stats = rows.agg(*[F.avg(c).alias(f"_m{k}") for k, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"_s{k}") for k, c in enumerate(columns)])
    joined = rows.crossJoin(F.broadcast(stats))  # one row
    z = [F.coalesce(F.try_divide(F.col(c) - F.col(f"_m{k}"), F.col(f"_s{k}")), F.lit(0.0)).alias(f"z{k + 1}") for k, c in enumerate(columns)]
    return joined.select(*rows.columns, *z)


def _linear(coefficients: tuple[float, ...]):
    return sum((c * F.col(f"z{k + 1}") for k, c in enumerate(coefficients)), F.lit(0.0))


def action_intercept(rows: DataFrame, target: float, steps: int = 8, ways: int = 16) -> float:
    """The intercept at which the mean clipped removal probability is ``target``: each step tries ``ways`` intercepts in one aggregate."""
    low, high = -20.0, 20.0
    for _ in range(steps):
        tries = [low + (high - low) * k / ways for k in range(ways + 1)]
        clipped = lambda a: F.greatest(F.least(expit(_linear(ACTION_COEFFICIENTS) + F.lit(a)), F.lit(ACTION_HIGH)), F.lit(ACTION_LOW))
        means = rows.agg(*[F.avg(clipped(a)).alias(f"m{k}") for k, a in enumerate(tries)]).first()
        k = max((k for k in range(ways) if (means[k] or 0) <= target), default=0)
        low, high = tries[k], tries[k + 1]
    return (low + high) / 2


def trajectories(rows: DataFrame, intercept: float, seed: int, randomised: float | None = None) -> DataFrame:
    """A simulated first removal for each episode.

    Until removal the decision at row k depends on row k alone, so the trajectory is a first success: the removal is at the smallest k with
    u_k < p_k. ``sim_remove_index`` is null where none succeeds; ``sim_state`` and ``sim_action`` follow by comparing indices.
    """
    p = F.lit(randomised) if randomised is not None else F.greatest(F.least(expit(_linear(ACTION_COEFFICIENTS) + F.lit(intercept)), F.lit(ACTION_HIGH)), F.lit(ACTION_LOW))
    drawn = rows.withColumn("p_remove", p).withColumn("u_remove", uniform(seed, F.col("entity"), F.floor(F.col("inserted") / 1_000_000), F.col("episode_index")))
    first = F.min(F.when(F.col("u_remove") < F.col("p_remove"), F.col("episode_index"))).over(Window.partitionBy(*EPISODE))
    k = F.col("episode_index")
    out = drawn.withColumn("sim_remove_index", first)
    at = F.col("sim_remove_index")
    return out.select("*", F.when(at.isNull() | (k <= at), "in").otherwise("out").alias("sim_state"), F.when(at.isNull() | (k < at), "keep").when(k == at, "remove").otherwise("out").alias("sim_action"))


def outcome_probability(action):
    """The outcome's probability under an action column: the treatment effect from removal on."""
    return expit(_linear(OUTCOME_COEFFICIENTS) + F.lit(OUTCOME_INTERCEPT) + F.when(action.isin("remove", "out"), F.lit(TREATMENT)).otherwise(0.0))


def first_outcomes(rows: DataFrame, seed: int, action: str = "sim_action") -> DataFrame:
    """``sim_outcome``: drawn with uniforms that don't depend on the action; only an episode's first event stays, and the risk ends after it."""
    drawn = rows.withColumn("p_outcome", outcome_probability(F.col(action))).withColumn("u_outcome", uniform(seed + 1, F.col("entity"), F.floor(F.col("inserted") / 1_000_000), F.col("episode_index")))
    first = F.min(F.when(F.col("u_outcome") < F.col("p_outcome"), F.col("episode_index"))).over(Window.partitionBy(*EPISODE))
    marked = drawn.withColumn("_first", first)
    k = F.col("episode_index")
    return marked.select("*", F.coalesce((k == F.col("_first")).cast("int"), F.lit(0)).alias("sim_outcome"), F.coalesce((k <= F.col("_first")).cast("int"), F.lit(1)).alias("sim_at_risk")).drop("_first")


def known_values(policy_rows: DataFrame, horizon_days: int | None = None) -> DataFrame:
    """The true risk of each policy: the mean over episodes of 1 - prod(1 - p) with p under the policy's own action."""
    rows = policy_rows if horizon_days is None else policy_rows.where(F.col("period_start") - F.col("inserted") < F.lit(horizon_days * DAY))
    risks = rows.withColumn("p_true", outcome_probability(F.col("policy_action"))).groupBy("policy", *EPISODE).agg(any_event(F.col("p_true")).alias("risk"))
    return risks.groupBy("policy").agg(F.avg("risk").alias("true_risk"), F.count("*").alias("n_episodes"))


def coefficients(spark) -> DataFrame:
    rows = [("action", f"z{k + 1}", c) for k, c in enumerate(ACTION_COEFFICIENTS)] + [("outcome", "intercept", OUTCOME_INTERCEPT), *[("outcome", f"z{k + 1}", c) for k, c in enumerate(OUTCOME_COEFFICIENTS)], ("outcome", "treatment", TREATMENT)]
    return spark.createDataFrame(rows, "model string, term string, value double")
