"""Reports on the panel, on predictions under policies and on fits, with their SQL where no model of ``pyspark.ml`` is fitted."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.checkpoints import cut, shared_dir
from chronopanel.functions.stats import effective_size, positive_effective_size, rounded, smoothed
from chronopanel.operators import attach, features, folds, intervals, learners, metrics, policy, reports
from chronopanel.plans import oracle
from chronopanel.plans.longitudinal import DAYS, EPISODE, MODEL_FEATURES, WIDE, base, cleaned, hazards, model_rows, policy_scores, scored_decisions, with_stay
from chronopanel.sources import sinks, tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Policies

#: prediction: its flag in the panel, the flag of rows at risk of it (None: all).
PREDICTED = {"outcome": ("outcome_in", "at_risk_outcome"), "reinsertion": ("reinsertion_in", "at_risk_reinsertion"), "death": ("death_in", None), "exit_alive": ("exit_alive_in", None), "no_event": ("no_event_in", None)}
#: Cells of a state and its elapsed period (counted up to the first number) with fewer rows than the second give no prediction.
LONGEST, FEWEST = 30, 20


def predicted_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows under observed practice and under each fixed-day policy, with five predicted rates by state and elapsed period."""
    rows = reports.with_durations(base(spark, folder), "period_start", "period_end").withColumn("no_event_in", 1 - F.greatest("reinsertion_in", "death_in", "exit_alive_in"))
    period = lambda c: F.least(c, F.lit(LONGEST))
    risk = lambda r: F.col(r) if r else F.lit(1)
    cells = rows.groupBy(F.col("state").alias("h_state"), period(F.col("periods_in_state")).alias("h_period")).agg(F.count("*").alias("h_n"), *[smoothed(F.sum(F.col(y) * risk(r)), F.sum(risk(r))).alias(f"p_{k}") for k, (y, r) in PREDICTED.items()])
    cells = cells.where(F.col("h_n") >= FEWEST)
    columns = ["policy", "policy_day", *EPISODE, "episode_day", "policy_state", "policy_action", "extra_row_out", "duration_days", "long_duration", "clock"]
    seen = rows.select(F.lit(policy.CURRENT).alias("policy"), F.lit(None).cast("bigint").alias("policy_day"), *EPISODE, "episode_day", F.col("state").alias("policy_state"), F.col("action").alias("policy_action"), F.lit(0).alias("extra_row_out"), "duration_days", "long_duration", F.col("periods_in_state").alias("clock"))
    fixed = policy.with_policies(rows, DAYS).withColumn("clock", F.coalesce("policy_periods_in", F.greatest("policy_periods_out", F.lit(1)))).select(*columns)
    both = seen.select(*columns).unionByName(fixed)
    return both.join(cells, (F.col("h_state") == F.col("policy_state")) & (F.col("h_period") == period(F.col("clock"))), "left")


def _diagnostics_sql() -> str:
    names = list(PREDICTED)
    cells = ", ".join(f"(sum({y} * {r or 1}) + 1) / (sum({r or 1}) + 2.0) AS p_{k}" for k, (y, r) in PREDICTED.items())
    per_row = {
        "n_rows": "true",
        "n_in_rows": "policy_state = 'in'",
        "n_out_rows": "policy_state = 'out'",
        "n_remove_rows": "policy_action = 'remove'",
        "n_extra_rows_out": "extra_row_out = 1",
        "n_bad_durations": "period_end <= period_start",
        "n_long_durations": "period_end - period_start > 7 * 86400000000",
        **{f"n_missing_{k}": f"p_{k} IS NULL" for k in names},
        **{f"n_{k}_below_0": f"p_{k} < 0" for k in names},
        **{f"n_{k}_above_1": f"p_{k} > 1" for k in names},
    }
    bounds = ", ".join(f"round(min(p_{k}), 6) AS least_{k}, round(max(p_{k}), 6) AS most_{k}" for k in names)
    known = " AND ".join(f"p_{k} IS NOT NULL" for k in names)
    any_of = lambda test: " + ".join(f"count(*) FILTER (WHERE p_{k} {test})" for k in names)
    return (
        f"WITH {oracle.POLICY}, flagged AS (SELECT *, 1 - greatest(reinsertion_in, death_in, exit_alive_in) AS no_event_in FROM panel), "
        f"cells AS (SELECT state AS h_state, least(periods_in_state, {LONGEST}) AS h_period, {cells} FROM flagged GROUP BY 1, 2 HAVING count(*) >= {FEWEST}), "
        "asked AS (SELECT 'current_practice' AS policy, NULL::BIGINT AS policy_day, entity, inserted, episode_day, state AS policy_state, action AS policy_action, 0 AS extra_row_out, period_start, period_end, periods_in_state AS clock FROM panel "
        "UNION ALL SELECT policy, policy_day, entity, inserted, episode_day, policy_state, policy_action, extra_row_out, period_start, period_end, coalesce(policy_periods_in, greatest(policy_periods_out, 1)) FROM pol), "
        f"r AS (SELECT *, count(*) OVER (PARTITION BY policy, entity, inserted, episode_day) AS same_day FROM asked LEFT JOIN cells ON h_state = policy_state AND h_period = least(clock, {LONGEST})), "
        f"e AS (SELECT policy, entity, inserted, count(*) FILTER (WHERE policy_state = 'in') AS n_in, count(*) FILTER (WHERE policy_action = 'remove') AS n_remove, coalesce(bool_or(episode_day = policy_day), false) AS reaches, coalesce(count(*) FILTER (WHERE policy_state = 'in') > any_value(policy_day), false) AS too_long, bool_and({known}) AS complete, "
        "coalesce(sum((period_end - period_start) / 86400000000.0) FILTER (WHERE policy_state = 'in'), 0) AS days_in FROM r GROUP BY ALL), "
        "es AS (SELECT policy, count(*) AS n_episodes, count(DISTINCT entity) AS n_entities, count(*) FILTER (WHERE reaches) AS n_episodes_reaching_day, count(*) FILTER (WHERE n_remove > 1) AS n_episodes_several_removals, count(*) FILTER (WHERE too_long) AS n_episodes_in_too_long, count(*) FILTER (WHERE complete) AS n_complete_episodes, count(*) FILTER (WHERE NOT complete) AS n_incomplete_episodes, round(avg(n_in), 6) AS mean_in_rows, round(avg(days_in), 6) AS mean_exposure_days, sum(n_remove) AS removes FROM e GROUP BY policy), "
        f"rs AS (SELECT policy, policy_day, {', '.join(f'count(*) FILTER (WHERE {c}) AS {k}' for k, c in per_row.items())}, {bounds}, count(*) FILTER (WHERE same_day > 1) AS n_repeated_day_rows, {any_of('< 0')} AS n_predictions_below_0, {any_of('> 1')} AS n_predictions_above_1 FROM r GROUP BY policy, policy_day) "
        "SELECT rs.*, es.* EXCLUDE (policy, removes), CASE WHEN policy_day IS NULL THEN 'observed' ELSE 'fixed_day' END AS policy_type, CASE WHEN policy_day IS NOT NULL THEN n_episodes_reaching_day - n_remove_rows END AS n_removal_shortfall FROM rs JOIN es USING (policy)"
    )


@query(_diagnostics_sql())
def policy_row_diagnostics(spark, folder):
    """All counts, bounds and totals of the rows and predictions under each policy."""
    return rounded(reports.policy_diagnostics(predicted_rows(spark, folder), list(PREDICTED), EPISODE))


@query(
    f"WITH {oracle.SCORES}, w AS (SELECT policy, fold, entity, inserted, count(*) AS n_steps, product(ratio) AS weight FROM sc GROUP BY ALL) SELECT policy, fold, least(n_steps, 8) AS n_steps, count(*) AS n, count(*) FILTER (WHERE weight > 0) AS n_positive, "
    "round(coalesce(pow(sum(weight), 2) / nullif(sum(weight * weight), 0), 0), 6) AS effective_size, round(pow(sum(weight) FILTER (WHERE weight > 0), 2) / sum(weight * weight) FILTER (WHERE weight > 0), 6) AS positive_effective_size FROM w GROUP BY 1, 2, 3"
)
def effective_sizes(spark, folder):
    """Effective sample sizes of the trajectories' weights by policy, fold and length (8 at most): 0 in one variant, null in the other, where none has weight."""
    w = reports.last_weights(policy_scores(spark, folder), ["policy", "fold", *EPISODE])
    return rounded(w.groupBy("policy", "fold", F.least("n_steps", F.lit(8)).cast("bigint").alias("n_steps")).agg(F.count("*").alias("n"), F.count_if(F.col("weight") > 0).alias("n_positive"), effective_size(F.col("weight")).alias("effective_size"), positive_effective_size(F.col("weight")).alias("positive_effective_size")))


_DAYS = "(removed - inserted) / 86400000000.0"


@query(f"WITH {oracle.MERGED} SELECT CAST({_DAYS} > 7 AS INT) AS long_duration, count(*) AS n, round(min({_DAYS}), 6) AS least, round(avg({_DAYS}), 6) AS mean, round(max({_DAYS}), 6) AS most FROM merged GROUP BY 1")
def exposure_durations(spark, folder):
    """Merged exposures of more than seven days and the others."""
    days, merged = F.col("duration_days"), intervals.merge_intervals(tables.exposures(tables.events(spark, folder)), ["entity"])
    return rounded(reports.with_durations(merged, "start", "end").groupBy("long_duration").agg(F.count("*").alias("n"), F.min(days).alias("least"), F.avg(days).alias("mean"), F.max(days).alias("most")))


# Overviews

LATE = 7


@query(f"WITH {oracle.PANEL}, fst AS (SELECT entity, arg_min(death IS NULL, (inserted, episode_index)) AS lacks FROM panel GROUP BY entity) SELECT count(*) AS n_rows, count(DISTINCT entity) AS n_entities, (SELECT count(*) FROM fst WHERE lacks) AS n_entities_missing_death, count(DISTINCT (entity, unit_in)) AS n_stays, count(DISTINCT (entity, inserted)) AS n_episodes FROM panel")
def cohort_overview(spark, folder):
    return reports.cohort_overview(base(spark, folder), ["entity", "unit_in"], EPISODE, "death", ["inserted", "episode_index"])


@query(f"WITH {oracle.PANEL} SELECT state, count(*) AS n_rows, count(DISTINCT entity) AS n_entities, count(DISTINCT (entity, inserted)) AS n_episodes FROM panel GROUP BY state")
def state_overview(spark, folder):
    return reports.state_overview(base(spark, folder), EPISODE)


_SETS = {"removal_on_decisions": ("is_decision", "removed_in"), "late_removal_on_decisions": (f"is_decision AND episode_day >= {LATE}", "removed_in"), "outcome_at_risk": ("at_risk_outcome = 1", "outcome_in"), "reinsertion_at_risk": ("at_risk_reinsertion = 1", "reinsertion_in")}


@query(f"WITH {oracle.PANEL} " + " UNION ALL ".join(f"SELECT '{k}' AS analysis_set, count(*) AS n_rows, coalesce(sum({y}), 0)::BIGINT AS events, round(avg({y}), 6) AS event_rate FROM panel WHERE {m}" for k, (m, y) in _SETS.items()))
def event_overview(spark, folder):
    return rounded(reports.event_overview(base(spark, folder), {k: (F.expr(m), y) for k, (m, y) in _SETS.items()}))


_ROW_SETS = {
    "all_rows": "true",
    "in_rows": "state = 'in'",
    "out_rows": "state = 'out'",
    "out_rows_up_to_two_periods": "state = 'out' AND periods_in_state <= 2",
    "outcome_risk_rows": "at_risk_outcome = 1",
    "decision_rows": "is_decision",
    "reinsertion_risk_rows": "at_risk_reinsertion = 1",
    "after_outcome_excluded": "coalesce(outcome > inserted AND outcome <= period_start, false) AND at_risk_outcome = 0",
    "not_at_risk_of_reinsertion": "at_risk_reinsertion = 0",
}


@query(f"WITH {oracle.PANEL} " + " UNION ALL ".join(f"SELECT '{k}' AS metric, count(*) AS value FROM panel WHERE {m}" for k, m in _ROW_SETS.items()))
def risk_set_summary(spark, folder):
    return reports.counts(base(spark, folder), {k: F.expr(m) for k, m in _ROW_SETS.items()})


_FEATURE = "max(CASE WHEN item = '{0}' THEN round_even(\"{1}\"::DOUBLE, 3) END)"


@query(
    f"WITH {oracle.FEATURES}, wide AS (SELECT p.entity, p.inserted, p.episode_index, {_FEATURE.format('view', 'mean')} AS view__mean, {_FEATURE.format('click', 'mean')} AS click__mean, {_FEATURE.format('view', 'last')} AS view__last FROM panel p LEFT JOIN stats USING (entity, inserted, episode_index) GROUP BY 1, 2, 3), "
    "d AS (SELECT panel.*, view__mean, click__mean, view__last, CAST(click__mean IS NULL AS INT) AS click__mean__missing, (unit_out - unit_in) / 86400000000.0 AS stay_days FROM panel JOIN wide USING (entity, inserted, episode_index)), "
    "ep AS (SELECT entity, inserted, any_value(stay_days) AS stay_days, sum(interval_hours) FILTER (WHERE state = 'in') / 24 AS exposure_days, max(periods_in_state) FILTER (WHERE state = 'in') AS in_periods, CAST(coalesce(max(periods_in_state) FILTER (WHERE state = 'in') >= 7, false) AS INT) AS late_removal, max(outcome_in) AS any_outcome, max(reinsertion_in) AS any_reinsertion, "
    "median(view__mean) FILTER (WHERE is_decision) AS decision_view__mean, arg_min(click__mean__missing, episode_index) AS click__mean__missing, median(click__mean) FILTER (WHERE at_risk_outcome = 1) AS risk_click__mean, median(view__last) FILTER (WHERE at_risk_reinsertion = 1) AS reinsertion_view__last FROM d GROUP BY ALL) "
    "SELECT entity, inserted, round(stay_days, 6) AS stay_days, round(exposure_days, 6) AS exposure_days, in_periods, late_removal, any_outcome, any_reinsertion, round(decision_view__mean, 6) AS decision_view__mean, click__mean__missing, round(risk_click__mean, 6) AS risk_click__mean, round(reinsertion_view__last, 6) AS reinsertion_view__last, "
    "round(median(stay_days) OVER (), 6) AS stay_days_median, CAST(stay_days >= median(stay_days) OVER () AS DOUBLE) AS stay_days_ge_median FROM ep"
)
def episode_level(spark, folder):
    """All aggregates of each episode: exposure, events, and medians of look-back features over the rows where they matter."""
    rows = cut(base(spark, folder))
    wide = features.wide(rows, features.lookback(cleaned(spark, folder), rows), WIDE).withColumn("stay_days", (F.col("unit_out") - F.col("unit_in")) / 8.64e10)
    return rounded(reports.episode_level(wide, EPISODE, "stay_days", "view__mean", "click__mean__missing", "click__mean", "view__last", LATE, split=True))


# Reading


@query(
    "WITH e AS (SELECT event_id, event_type AS item, CASE event_id % 5 WHEN 0 THEN ' f ' WHEN 1 THEN 'Deg F' WHEN 2 THEN 'C' END AS unit, value FROM events), "
    "h AS (SELECT *, upper(trim(coalesce(unit, ''))) IN ('F', 'DEG F') OR item = 'click' AS hot FROM e) "
    "SELECT CASE WHEN hot THEN 'view' ELSE item END AS item, CASE WHEN hot THEN 'c' ELSE unit END AS unit, hot AS was_converted, count(*) AS n, round(sum(CASE WHEN hot THEN (value - 32) * (5.0 / 9.0) ELSE value END), 3) AS total "
    "FROM h WHERE hot OR item IN ('view', 'error') GROUP BY ALL"
)
def normalised_units(spark, folder):
    """Fahrenheit rows, by unit or item, become rows of the Celsius item and unit; then the kept items stay."""
    k = F.col("event_id") % 5
    rows = spark.read.parquet(f"{folder}/events.parquet").select(F.col("event_type").alias("item"), F.when(k == 0, " f ").when(k == 1, "Deg F").when(k == 2, "C").alias("unit"), "value")
    found = features.normalised_units(rows, ("F", "DEG F"), ("click",), "view", "c", ("view", "error"))
    return found.groupBy("item", "unit", "was_converted").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("SELECT user_id % 7 AS item, CAST(arg_min(user_id, event_id) AS VARCHAR) AS label FROM events WHERE user_id IS NOT NULL GROUP BY 1")
def first_read_labels(spark, folder):
    """The label of each item's first row in the order of reading (event_id)."""
    rows = spark.read.parquet(f"{folder}/events.parquet").select((F.col("user_id") % 7).alias("item"), F.col("user_id").cast("string").alias("label"), "event_id")
    return tables.first_labels(rows, order="event_id")


# Fits

_CELL = "greatest(len([e for e in list_distinct(edges) if e < g]) - 1, 0)"


@query(
    f"WITH {oracle.SCORES}, s AS (SELECT removed_in AS action_removed, prop.p AS g, reward_outcome AS y FROM decf JOIN prop ON g_day = least(episode_day, 6) AND prop.fold = decf.fold), "
    "ed AS (SELECT action_removed, quantile_cont(g, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS edges FROM s GROUP BY 1) "
    f"SELECT action_removed, CAST({_CELL} AS BIGINT) AS bin, count(*) AS n, sum(y)::BIGINT AS events, round(min(g), 6) AS least_p, round(avg(g), 6) AS mean_p, round(max(g), 6) AS most_p, round(avg(y), 6) AS rate FROM s JOIN ed USING (action_removed) GROUP BY 1, 2"
)
def calibration_by_action_quantiles(spark, folder):
    """Calibration under either observed action, in bins between the quantiles of that action's own scores."""
    rows = scored_decisions(spark, folder).select("action_removed", F.col("g").alias("p"), F.col("reward_outcome").alias("y"))
    return rounded(metrics.calibration(rows, 10, "action_removed"))


def saved_scores(spark: SparkSession, folder: str) -> str:
    """Cross-fitted outcome scores of decisions under their observed action, written in the shared folder; its path."""
    path = f"{shared_dir(spark)}/scores-{uuid.uuid4().hex}"
    observed = F.when(F.col("action_removed") == 1, F.col("q_remove")).otherwise(F.col("q_keep"))
    sinks.dataset(scored_decisions(spark, folder).select(*EPISODE, "episode_index", "fold", observed.alias("p")), path)
    return path


@query(
    f"WITH {oracle.SCORES}, {oracle.HAZARDS}, saved AS (SELECT entity, inserted, episode_index, decf.fold, qrate.p FROM decf JOIN qrate ON q_day = least(episode_day, 6) AND qrate.fold = decf.fold AND q_action = removed_in) "
    "SELECT entity, inserted, episode_index, fold, round(coalesce(saved.p, h_outcome), 6) AS p, saved.p IS NOT NULL AS was_saved FROM panel JOIN fold USING (entity) JOIN haz ON h_state = state AND h_period = least(periods_in_state, 5) LEFT JOIN saved USING (entity, inserted, episode_index, fold)"
)
def saved_scores_filled(spark, folder):
    """Scores that an earlier fit saved, read back by entity, episode, period and fold; the rows that it didn't score are scored anew by hazards."""
    saved = spark.read.parquet(saved_scores(spark, folder))
    rows = base(spark, folder).join(saved.select("entity", "fold").distinct(), "entity")
    scored = rows.join(hazards(rows), (F.col("h_state") == F.col("state")) & (F.col("h_period") == F.least("periods_in_state", F.lit(5)))).select(*EPISODE, "episode_index", "fold", "h_outcome")
    return rounded(attach.filled(scored, saved, [*EPISODE, "episode_index", "fold"], "p", "h_outcome").drop("h_outcome"))


@query()
def saved_importances(spark, folder):
    """The fifteen most important features of each learner, from the table that the fits saved."""
    path = f"{shared_dir(spark)}/importances-{uuid.uuid4().hex}"
    rows = model_rows(spark, folder)
    found = [learners.importances(rows, MODEL_FEATURES, "removed_in", name=n, top=15) for n in ("logistic", "forest", "boosted")]
    sinks.dataset(reduce(DataFrame.unionByName, found), path)
    return rounded(spark.read.parquet(path))


@query()
def outcome_metrics(spark, folder):
    """Discrimination and squared error of cross-fitted models of the action and of four events, each over its own risk set, overall and by fold."""
    names = {"removed_in": "is_decision", "outcome_in": "at_risk_outcome = 1", "reinsertion_in": "at_risk_reinsertion = 1", "death_in": "true", "exit_alive_in": "true"}
    rows, path = with_stay(spark, folder), f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    rows = rows.join(folds.grouped_folds(rows).select("entity", "fold"), "entity").select("fold", "is_decision", "at_risk_outcome", "at_risk_reinsertion", *names, *[F.col(c).cast("double").alias(c) for c in MODEL_FEATURES])
    rows.write.partitionBy("fold").parquet(path)  # a fold's fit and scores read its own files
    rows, parts = spark.read.schema(rows.schema).parquet(path), []
    for label, at_risk in names.items():
        scored = learners.crossfit(rows.where(at_risk), MODEL_FEATURES, label).select(F.col(label).alias("y"), "p", F.explode(F.array(F.lit("all"), F.concat(F.lit("fold_"), F.col("fold").cast("string")))).alias("part"))
        parts.append(scored.select(F.concat(F.lit(f"{label}/"), "part").alias("group"), "y", "p"))
    found = metrics.binary_metrics(reduce(DataFrame.unionByName, parts))
    return rounded(found.select(F.split("group", "/")[0].alias("target"), F.split("group", "/")[1].alias("part"), *[c for c in found.columns if c != "group"]))
