"""Exposure episodes and their period panel: endpoints, risk sets, clocks, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.stats import flag
from chronopanel.functions.time import DAY, HOUR, floor_div, hours, in_window, period_number
from chronopanel.operators.intervals import first_endpoint, first_in_window, merge_intervals, to_grid, with_next

LEAST_EPISODE = DAY
OUTCOME_WINDOW = 48 * HOUR
ENDPOINTS = [("death", "death"), ("reinsertion", "reinsertion"), ("unit_out", "exit_alive")]
EPISODE = ["entity", "inserted"]


def episodes(intervals: DataFrame, stays: DataFrame, outcomes: DataFrame, least: int = LEAST_EPISODE, window: int = OUTCOME_WINDOW) -> DataFrame:
    """Exposure episodes from raw intervals (entity, start, end), stays (entity, unit_in, unit_out, death) and outcome times (entity, t).

    Overlapping intervals are one episode. Deaths outside the stay don't count. Episodes that start at or after death or exit go;
    the next start is then the reinsertion. An episode ends at the first of death, reinsertion, exit (in that order at
    equal times), and must be exposed for ``least`` before that. ``outcome``: the first time in [inserted, end of exposure plus ``window``], up to the end.
    """
    inside = stays.withColumn("death", F.when(F.col("death").between(F.col("unit_in"), F.col("unit_out")), F.col("death")))
    merged = merge_intervals(intervals, ["entity"]).select("entity", F.col("start").alias("inserted"), F.col("end").alias("removed"))
    started = merged.join(inside, "entity").where(F.col("inserted") < F.least("death", "unit_out"))
    linked = with_next(started, ["entity"], "inserted", "inserted", "reinsertion")
    at, reason = first_endpoint(ENDPOINTS)
    ended = linked.withColumn("episode_end", at).withColumn("end_reason", reason)
    long = ended.where(F.least("removed", "episode_end") - F.col("inserted") >= least).withColumn("window_end", F.least(F.col("removed") + F.lit(window), F.col("episode_end")))
    return first_in_window(long, outcomes, "entity", "inserted", "window_end", "outcome").drop("window_end")


def base_panel(eps: DataFrame, period: int = DAY, window: int = OUTCOME_WINDOW) -> DataFrame:
    """One row for each period of each episode. Events belong to (start, end]; the state is that at the start."""
    rows = to_grid(eps, "inserted", "episode_end", period)
    start, end, removed = F.col("period_start"), F.col("period_end"), F.col("removed")
    last = F.col("period_end") == F.col("episode_end")
    state_in = start < removed
    exposed = hours(F.greatest(F.least(end, F.least("removed", "episode_end")) - start, F.lit(0)))
    flagged = rows.select(
        "*",
        F.when(state_in, "in").otherwise("out").alias("state"),
        state_in.alias("is_decision"),
        F.when(state_in, F.col("episode_index") + 1).otherwise(floor_div(start - removed, period) + 1).alias("periods_in_state"),
        F.when(state_in, F.lit(0).cast("bigint")).otherwise(floor_div(start - removed, period) + 1).alias("reinsertion_periods"),
        hours(end - start).alias("interval_hours"),
        exposed.alias("hours_in"),
        (hours(end - start) - exposed).alias("hours_out"),
        flag(state_in & (removed < F.col("episode_end")) & in_window(removed, start, end)).alias("removed_in"),
        flag(in_window(F.col("outcome"), start, end)).alias("outcome_in"),
        *[flag(last & (F.col("end_reason") == name)).alias(f"{name}_in") for _, name in ENDPOINTS],
        F.when(last, F.col("end_reason")).alias("final_reason"),
    )
    before = F.coalesce(F.sum("outcome_in").over(Window.partitionBy(*EPISODE).orderBy("episode_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    action = F.when(~F.col("is_decision"), "out").when(F.col("removed_in") == 1, "remove").otherwise("keep")
    return flagged.select(
        "*",
        flag((start < removed + F.lit(window)) & (before == 0)).alias("at_risk_outcome"),
        flag(F.col("hours_out") > 0).alias("at_risk_reinsertion"),
        action.alias("action"),
        F.greatest(F.col("unit_in"), start - F.lit(period)).alias("look_start"),
        period_number(start - F.col("inserted"), period).alias("episode_day"),
    )


def violations(panel: DataFrame, window: int = OUTCOME_WINDOW) -> DataFrame:
    """One row of counts, all zero for a valid panel: what a strict reader would refuse."""
    w = Window.partitionBy(*EPISODE).orderBy("episode_index")
    seen = panel.select(
        "*",
        (F.row_number().over(w) - 1).alias("expected_index"),
        F.lag("period_end").over(w).alias("previous_end"),
        F.lead("period_start").over(w).isNull().alias("is_last"),
        F.coalesce(F.sum("outcome_in").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("prior"),
    )
    ends = F.col("death_in") + F.col("reinsertion_in") + F.col("exit_alive_in")
    checks = {
        "broken_order": F.col("episode_index") != F.col("expected_index"),
        "gaps": F.col("previous_end") != F.col("period_start"),
        "empty_periods": F.col("period_end") <= F.col("period_start"),
        "beyond_end": F.col("period_end") > F.col("episode_end"),
        "open_end": F.col("is_last") & (F.col("period_end") != F.col("episode_end")),
        "wrong_endpoint": ends != F.col("is_last").cast("int"),
        "event_outside_risk": (F.col("outcome_in") == 1) & (F.col("at_risk_outcome") == 0),
        "risk_after_event": (F.col("prior") > 0) & (F.col("at_risk_outcome") == 1),
        "wrong_risk_window": F.col("at_risk_outcome") != flag((F.col("period_start") < F.col("removed") + F.lit(window)) & (F.col("prior") == 0)),
        "reinsertion_outside_risk": F.col("reinsertion_in") > F.col("at_risk_reinsertion"),
        "removal_outside_state": (F.col("removed_in") == 1) & ~F.col("is_decision"),
    }
    return seen.agg(*[F.count_if(c).alias(k) for k, c in checks.items()])


def decisions(panel: DataFrame) -> DataFrame:
    """The decision rows of each episode with what follows from them.

    Rows after the exposure count towards the last decision. decision_period from 1, next_index (null for the last), reward_*:
    sums over the decision's rows, n_linked_out.
    """
    w = Window.partitionBy(*EPISODE)
    target = F.least(F.col("episode_index"), F.max(F.when(F.col("is_decision"), F.col("episode_index"))).over(w))
    rows = panel.withColumn("target", target).withColumn("nominal_days", F.when(F.col("is_decision"), F.col("interval_hours") / 24).otherwise(0.0))
    rewards = rows.groupBy(*EPISODE, F.col("target").alias("episode_index")).agg(
        *[F.sum(f"{c}_in").alias(f"reward_{c}") for c in ("outcome", "reinsertion", "death", "exit_alive")],
        F.sum("nominal_days").alias("reward_exposure_days"),
        F.sum(F.col("hours_in") / 24).alias("actual_exposure_days"),
        F.count_if(~F.col("is_decision")).alias("n_linked_out"),
    )
    kept = rows.where("is_decision").join(rewards, [*EPISODE, "episode_index"])
    order = w.orderBy("episode_index")
    return kept.withColumn("decision_period", F.col("episode_index") + 1).withColumn("next_index", F.lead("episode_index").over(order))
