"""Counterfactual fixed-day policies on an observed panel, and their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.stats import any_event, effective_size

EPISODE = ["entity", "inserted"]
CURRENT = "current_practice"


def with_policies(panel: DataFrame, days: list[int]) -> DataFrame:
    """Each panel row once for each policy "remove on day d": state, action and clocks under it, and agreement with what was observed.

    Only the first row of the target day removes; further rows of that day count as out.
    ``dml_action`` asks for removal on observed decision rows from the target day on. The rows are exploded over a handful of
    days, so no join is needed.
    """
    rows = panel.withColumn("policy_day", F.explode(F.array(*[F.lit(d).cast("bigint") for d in days])))
    order = Window.partitionBy("policy_day", *EPISODE, "episode_day").orderBy("period_start", "period_end", "episode_index")
    ranked = rows.withColumn("row_in_day", F.row_number().over(order))
    day, target = F.col("episode_day"), F.col("policy_day")
    before, first = day < target, (day == target) & (F.col("row_in_day") == 1)
    inside = before | first
    action = F.when(before, "keep").when(first, "remove").otherwise("out")
    applied = ranked.select(
        "*",
        F.concat(F.lit("remove_on_day_"), target.cast("string")).alias("policy"),
        F.when(inside, "in").otherwise("out").alias("policy_state"),
        action.alias("policy_action"),
        F.when(inside, day).alias("policy_periods_in"),
        F.when(~inside, day - target).alias("policy_periods_out"),
        F.greatest(day - target, F.lit(0)).alias("policy_reinsertion_periods"),
        ((day == target) & (F.col("row_in_day") > 1)).cast("int").alias("extra_row_out"),
        F.when(F.col("is_decision"), F.when(day >= target, "remove").otherwise("keep")).otherwise("out").alias("dml_action"),
        (F.col("is_decision") & inside).alias("policy_applicable"),
    )
    of = Window.partitionBy("policy_day", *EPISODE)
    observed_day = F.min(F.when(F.col("removed_in") == 1, day)).over(of)
    policy_day = F.min(F.when(F.col("policy_action") == "remove", day)).over(of)
    today = F.when(F.col("policy_applicable"), (F.col("removed_in") == (F.col("policy_action") == "remove").cast("int")).cast("double"))
    return applied.withColumn("matches_today", today).withColumn("matches", F.coalesce(observed_day == policy_day, F.lit(False)))


def episode_risks(rows: DataFrame, hazards: list[str]) -> DataFrame:
    """One row for each policy and episode: 1 - prod(1 - hazard) of each hazard column, exposure, whether every hazard was known."""
    known = F.lit(True)
    for h in hazards:
        known = known & F.col(h).isNotNull()
    return rows.groupBy("policy", *EPISODE).agg(
        *[any_event(F.col(h)).alias(h.replace("hazard_", "risk_")) for h in hazards],
        F.sum(F.when(F.col("policy_state") == "in", F.col("interval_hours") / 24).otherwise(0.0)).alias("exposure_days"),
        F.bool_and(known).alias("complete"),
        F.count("*").alias("n_rows"),
    )


def summary(risks: DataFrame, values: list[str]) -> DataFrame:
    """Means over complete episodes for each policy, with counts."""
    done = F.col("complete")
    return risks.groupBy("policy").agg(
        F.count_distinct("entity").alias("n_entities"),
        F.count("*").alias("n_episodes"),
        F.count_if(done).alias("n_complete"),
        *[F.avg(F.when(done, F.col(v))).alias(v) for v in values],
    )


def contrasts(summaries: DataFrame, values: list[str], baseline: str = CURRENT) -> DataFrame:
    """Difference to the baseline policy and ratio, null where the baseline is null or zero."""
    base = summaries.where(F.col("policy") == baseline).select(*[F.col(v).alias(f"_{v}") for v in values])
    joined = summaries.crossJoin(F.broadcast(base))  # one row
    return joined.select(*summaries.columns, *[(F.col(v) - F.col(f"_{v}")).alias(f"{v}_difference") for v in values], *[F.try_divide(F.col(v), F.col(f"_{v}")).alias(f"{v}_ratio") for v in values])


def probability(day_of_row: Column, g: Column, day: Column | None = None, chance: float | None = None) -> Column:
    """The chance that a policy removes: from ``day`` on surely, or with a fixed ``chance``, or as in practice (``g``)."""
    if day is not None:
        return (day_of_row >= day).cast("double")
    return F.lit(float(chance)) if chance is not None else g


def ratios(action: Column, pi: Column, g: Column, clip: float | Column | None = None) -> dict[str, Column]:
    """Importance ratio pi/g of the observed action (1: remove), raw and with g clipped, and what was clipped. An observed action that had no chance fails."""
    clip = F.lit(clip) if isinstance(clip, float) else clip
    used = g if clip is None else F.greatest(F.least(g, 1 - clip), clip)
    of = lambda p: F.when(action == 1, p).otherwise(1 - p)
    return {
        "policy_probability": of(pi),
        "behaviour_probability": of(g),
        "ratio_raw": F.when(of(g) > 0, of(pi) / of(g)).otherwise(F.raise_error(F.lit("an observed action has no behaviour probability")).cast("double")),
        "ratio": F.when(of(used) > 0, of(pi) / of(used)).otherwise(F.raise_error(F.lit("an observed action has no behaviour probability")).cast("double")),
        "clipped": (of(g) != of(used)).cast("int"),
        "overlap": pi * g + (1 - pi) * (1 - g),
        "agreement": F.when(pi.isin(0.0, 1.0), (action == pi).cast("double")),
    }


def recursive_scores(rows: DataFrame, keys: list[str], order: str = "decision_period") -> DataFrame:
    """The recursive doubly robust score of each decision from q_keep, q_remove, action, pi, ratio, reward.

    score_t = qbar_t + ratio_t * (reward_t + score_{t+1} - q_observed_t) is linear in the next score. Each episode's decisions are gathered
    once, folded from the last back to the first and dealt out again, so work and memory are those of its number of decisions.
    """
    qbar = (1 - F.col("pi")) * F.col("q_keep") + F.col("pi") * F.col("q_remove")
    observed = F.when(F.col("action_removed") == 1, F.col("q_remove")).otherwise(F.col("q_keep"))
    base = rows.withColumn("qbar", qbar).withColumn("q_observed", observed).withColumn("b", F.col("qbar") + F.col("ratio") * (F.col("reward") - F.col("q_observed")))
    of = base.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*[c for c in base.columns if c not in keys]).alias("row")))).alias("rows"))
    start = F.struct(F.lit(0.0).alias("next"), F.array().cast("array<double>").alias("scores"))

    def back(acc, x):
        score = x["row"]["b"] + x["row"]["ratio"] * acc["next"]
        return F.struct(score.alias("next"), F.concat(acc["scores"], F.array(score)).alias("scores"))

    scores = F.aggregate(F.reverse("rows"), start, back)["scores"]
    dealt = of.select(*keys, F.explode(F.arrays_zip(F.col("rows.row").alias("row"), F.reverse(scores).alias("score"))).alias("x"))
    return dealt.select(*keys, "x.row.*", "x.score")


def cumulative_ratio(rows: DataFrame, keys: list[str], order: str = "decision_period") -> DataFrame:
    return rows.withColumn("cumulative_ratio", F.product("ratio").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def support(rows: DataFrame) -> DataFrame:
    """Weights' support by policy at three scopes: fold and period, period, and each episode's last decision."""
    last = rows.withColumn("_n", F.row_number().over(Window.partitionBy("policy", *EPISODE).orderBy(F.desc("decision_period")))).where("_n = 1")
    none = F.lit(None).cast("bigint")
    scoped = rows.select("*", F.lit("fold_period").alias("scope"), F.col("fold").alias("of_fold"), F.col("decision_period").alias("of_period")).unionByName(
        rows.select("*", F.lit("period").alias("scope"), none.alias("of_fold"), F.col("decision_period").alias("of_period"))
    ).unionByName(last.drop("_n").select("*", F.lit("episode_final").alias("scope"), none.alias("of_fold"), none.alias("of_period")))
    group = ["policy", "scope", "of_fold", "of_period"]
    by_entity = scoped.groupBy(*group, "entity").agg(F.sum("cumulative_ratio").alias("w")).groupBy(*group).agg(effective_size(F.col("w")).alias("entity_ess"), F.count_if(F.col("w") > 0).alias("n_contributing_entities"), F.count("*").alias("n_entities"))
    by_episode = scoped.groupBy(*group).agg(
        F.count("*").alias("n_episodes"),
        F.count_if(F.col("cumulative_ratio") > 0).alias("n_contributing_episodes"),
        effective_size(F.col("cumulative_ratio")).alias("episode_ess"),
        F.max("ratio").alias("ratio_max"),
        F.max("cumulative_ratio").alias("cumulative_max"),
        F.percentile("cumulative_ratio", 0.5).alias("cumulative_p50"),
        F.percentile("cumulative_ratio", 0.95).alias("cumulative_p95"),
        F.sum("clipped").alias("n_clipped"),
        F.min("behaviour_probability").alias("least_behaviour_probability"),
        F.avg("agreement").alias("mean_agreement"),
    )
    renamed = by_entity.select(*[F.col(c).alias(f"_{c}") for c in group], "entity_ess", "n_contributing_entities", "n_entities")
    same = F.lit(True)
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return by_episode.join(renamed, same).drop(*[f"_{c}" for c in group])
