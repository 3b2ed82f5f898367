"""Queries over the event tables: episodes, panel, features, policies, estimates. Each has its SQL in ``SQL`` unless a model is fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronopanel.functions.stats import rounded, smoothed
from chronopanel.functions.time import DAY
from chronopanel.checkpoints import cut
from chronopanel.operators import attach, bootstrap, features, folds, intervals, learners, metrics, panel, policy, rates, simulate
from chronopanel.plans import oracle
from chronopanel.sources import tables

DAYS = [1, 2, 3, 4, 5]
QUERIES: dict = {}
SQL: dict[str, str] = {}
EPISODE = ["entity", "inserted"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def episodes(spark: SparkSession, folder: str) -> DataFrame:
    ev = tables.events(spark, folder)
    return panel.episodes(tables.exposures(ev), tables.stays(ev), tables.outcomes(ev))


def base(spark: SparkSession, folder: str) -> DataFrame:
    return panel.base_panel(episodes(spark, folder))


def cleaned(spark: SparkSession, folder: str) -> DataFrame:
    values = tables.measurements(tables.events(spark, folder))
    return features.apply_rules(values, features.fit_rules(values))


@query(f"WITH {oracle.PANEL} SELECT end_reason, count(DISTINCT (entity, inserted)) AS n_episodes, count(*) AS n_periods, sum(removed_in)::BIGINT AS n_removed, sum(outcome_in)::BIGINT AS n_outcomes, round(sum(hours_in), 6) AS hours_in, round(sum(hours_out), 6) AS hours_out FROM panel GROUP BY end_reason")
def panel_terminal_summary(spark, folder):
    rows = base(spark, folder)
    return rounded(rows.groupBy("end_reason").agg(F.count_distinct(F.struct(*EPISODE)).alias("n_episodes"), F.count("*").alias("n_periods"), F.sum("removed_in").alias("n_removed"), F.sum("outcome_in").alias("n_outcomes"), F.sum("hours_in").alias("hours_in"), F.sum("hours_out").alias("hours_out")))


@query(f"WITH {oracle.MERGED} SELECT entity, inserted, removed, n_merged FROM merged")
def interval_merge(spark, folder):
    merged = intervals.merge_intervals(tables.exposures(tables.events(spark, folder)), ["entity"])
    return merged.select("entity", F.col("start").alias("inserted"), F.col("end").alias("removed"), "n_merged")


@query(f"WITH {oracle.EPISODES} SELECT entity, inserted, removed, reinsertion, episode_end, end_reason, outcome FROM eps")
def episode_endpoints(spark, folder):
    return episodes(spark, folder).select("entity", "inserted", "removed", "reinsertion", "episode_end", "end_reason", "outcome")


@query(f"WITH {oracle.EPISODES} SELECT end_reason, count(*) AS n, count(outcome) AS n_outcomes, round(avg((outcome - inserted) / 3600000000.0), 6) AS mean_hours FROM eps GROUP BY end_reason")
def first_event_in_window(spark, folder):
    return rounded(episodes(spark, folder).groupBy("end_reason").agg(F.count("*").alias("n"), F.count("outcome").alias("n_outcomes"), F.avg((F.col("outcome") - F.col("inserted")) / 3.6e9).alias("mean_hours")))


CORE = "entity, inserted, episode_index, period_start, period_end, state, is_decision, periods_in_state, reinsertion_periods, removed_in, outcome_in, death_in, reinsertion_in, exit_alive_in, at_risk_outcome, at_risk_reinsertion, action, look_start, episode_day"


@query(f"WITH {oracle.PANEL} SELECT {CORE}, round(interval_hours, 6) AS interval_hours, round(hours_in, 6) AS hours_in, round(hours_out, 6) AS hours_out FROM panel")
def base_panel(spark, folder):
    return rounded(base(spark, folder).select(*CORE.split(", "), "interval_hours", "hours_in", "hours_out"))


@query(f"WITH {oracle.PANEL} SELECT state, action, count(*) AS n, sum(at_risk_outcome)::BIGINT AS n_at_risk, sum(outcome_in)::BIGINT AS n_outcomes, sum(at_risk_reinsertion)::BIGINT AS n_at_risk_reinsertion, sum(reinsertion_in)::BIGINT AS n_reinsertions FROM panel GROUP BY state, action")
def risk_sets(spark, folder):
    return base(spark, folder).groupBy("state", "action").agg(F.count("*").alias("n"), F.sum("at_risk_outcome").alias("n_at_risk"), F.sum("outcome_in").alias("n_outcomes"), F.sum("at_risk_reinsertion").alias("n_at_risk_reinsertion"), F.sum("reinsertion_in").alias("n_reinsertions"))


CHECKS = ("broken_order", "gaps", "empty_periods", "beyond_end", "open_end", "wrong_endpoint", "event_outside_risk", "risk_after_event", "wrong_risk_window", "reinsertion_outside_risk", "removal_outside_state")


@query("SELECT " + ", ".join(f"CAST(0 AS BIGINT) AS {c}" for c in CHECKS))
def panel_violations(spark, folder):
    return panel.violations(base(spark, folder))


@query(f"WITH {oracle.MERGED}, spans AS (SELECT m.entity, greatest(unit_in, inserted - 86400000000) AS s, least(removed, unit_out) AS e FROM merged m JOIN stay USING (entity)), ok AS (SELECT * FROM spans WHERE e > s), fr2 AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY entity ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM ok), is2 AS (SELECT *, sum(f) OVER (PARTITION BY entity ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM fr2), win AS (SELECT entity, min(s) AS s, max(e) AS e FROM is2 GROUP BY entity, g) SELECT item, count(*) AS n, round(sum(value), 4) AS total FROM ev JOIN win ON ev.entity = win.entity AND t >= s AND t < e WHERE item IN ('view', 'click') GROUP BY item")
def extraction_windows(spark, folder):
    ev = tables.events(spark, folder)
    merged = intervals.merge_intervals(tables.exposures(ev), ["entity"]).join(tables.stays(ev), "entity")
    spans = merged.select("entity", F.greatest("unit_in", F.col("start") - DAY).alias("start"), F.least("end", "unit_out").alias("end"))
    inside = features.in_extraction_windows(tables.measurements(ev), intervals.merge_intervals(spans, ["entity"]))
    return inside.groupBy("item").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


RULE_COLUMNS = ("zero_fraction", "p5_nonzero", "low_clip", "high_clip", "low_delete", "high_delete")


@query(f"WITH {oracle.EVENTS}, {oracle.RULES} SELECT item, n_values, zero_to_missing, n_used, status, " + ", ".join(f"round({c}, 6) AS {c}" for c in RULE_COLUMNS) + " FROM rules")
def clean_rules(spark, folder):
    return rounded(features.fit_rules(tables.measurements(tables.events(spark, folder))).select("item", "n_values", "zero_to_missing", "n_used", "status", *RULE_COLUMNS))


@query(f"WITH {oracle.EVENTS}, {oracle.RULES} SELECT item, count(*) AS n, round(sum(value), 4) AS total, round(min(value), 6) AS least, round(max(value), 6) AS most FROM clean GROUP BY item")
def clean_apply(spark, folder):
    return cleaned(spark, folder).groupBy("item").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))


@query(f"WITH {oracle.FEATURES} SELECT entity, inserted, episode_index, item, \"count\", round(mean, 6) AS mean, round(std, 6) AS std, round(last, 6) AS last, round(slope_per_hour, 6) AS slope_per_hour FROM stats")
def lookback_stats(spark, folder):
    return rounded(features.lookback(cleaned(spark, folder), base(spark, folder)))


@query(
    f"WITH {oracle.FEATURES}, long AS (SELECT entity, item, unnest(['count', 'mean', 'std', 'last', 'slope_per_hour']) AS stat, unnest([\"count\"::DOUBLE, mean, std, last, slope_per_hour]) AS x FROM stats) "
    "SELECT item, stat, count(*) AS n_rows, round(count(*) / (SELECT count(*) FROM panel), 6) AS row_coverage, count(DISTINCT entity) AS n_entities, round(count(DISTINCT entity) / (SELECT count(DISTINCT entity) FROM panel), 6) AS entity_coverage, "
    "CASE WHEN count(*) / (SELECT count(*) FROM panel) >= 0.05 AND count(DISTINCT entity) / (SELECT count(DISTINCT entity) FROM panel) >= 0.1 THEN 'retain' ELSE 'drop' END AS decision FROM long WHERE x IS NOT NULL GROUP BY item, stat"
)
def feature_retention(spark, folder):
    rows = base(spark, folder)
    return rounded(features.retention(features.lookback(cleaned(spark, folder), rows), rows))


WIDE = [(i, s) for i in ("click", "view") for s in ("count", "mean", "last")]


@query(
    f"WITH {oracle.FEATURES} SELECT p.entity, p.inserted, p.episode_index, "
    + ", ".join(f"max(CASE WHEN item = '{i}' THEN round_even(\"{s}\"::DOUBLE, 3) END) AS {i}__{s}" for i, s in WIDE)
    + ", "
    + ", ".join(f"CAST(max(CASE WHEN item = '{i}' THEN \"{s}\" END) IS NULL AS INT) AS {i}__{s}__missing" for i, s in WIDE)
    + " FROM panel p LEFT JOIN stats USING (entity, inserted, episode_index) GROUP BY 1, 2, 3"
)
def feature_pivot(spark, folder):
    rows = base(spark, folder).select("entity", "inserted", "episode_index", "period_start", "look_start")
    wide = features.wide(rows, features.lookback(cleaned(spark, folder), rows), WIDE)
    return wide.drop("period_start", "look_start")


TIMELINE = "policy, entity, inserted, episode_index, policy_state, policy_action, policy_periods_in, policy_periods_out, policy_reinsertion_periods, extra_row_out, dml_action, policy_applicable"


@query(f"WITH {oracle.POLICY} SELECT {TIMELINE} FROM pol")
def policy_timeline(spark, folder):
    return policy.with_policies(base(spark, folder), DAYS).select(*TIMELINE.split(", "))


@query(f"WITH {oracle.POLICY} SELECT policy, count(*) AS n_rows, count(*) FILTER (WHERE matches) AS n_matching, count(matches_today) AS n_applicable, round(avg(matches_today), 6) AS agreement FROM pol GROUP BY policy")
def policy_match(spark, folder):
    rows = policy.with_policies(base(spark, folder), DAYS)
    return rounded(rows.groupBy("policy").agg(F.count("*").alias("n_rows"), F.count_if("matches").alias("n_matching"), F.count("matches_today").alias("n_applicable"), F.avg("matches_today").alias("agreement")))


@query(f"WITH {oracle.PANEL} SELECT state, least(periods_in_state, 10) AS period, count(*) AS n, sum(outcome_in)::BIGINT AS events, round(avg(outcome_in), 6) AS rate FROM panel GROUP BY 1, 2")
def event_rates(spark, folder):
    return rounded(base(spark, folder).groupBy("state", F.least("periods_in_state", F.lit(10)).alias("period")).agg(F.count("*").alias("n"), F.sum("outcome_in").alias("events"), F.avg("outcome_in").alias("rate")))


@query(
    f"WITH {oracle.PANEL}, long AS (SELECT unnest(['interval_hours', 'hours_in', 'hours_out', 'periods_in_state']) AS \"column\", unnest([interval_hours, hours_in, hours_out, periods_in_state::DOUBLE]) AS x FROM panel) "
    "SELECT \"column\", count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(min(x), 6) AS least, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.75), 6) AS q3, round(max(x), 6) AS most FROM long GROUP BY 1"
)
def describe_columns(spark, folder):
    return rounded(metrics.describe(base(spark, folder), ["interval_hours", "hours_in", "hours_out", "periods_in_state"]))


@query(f"WITH {oracle.PANEL} SELECT count(DISTINCT entity) AS n_entities, count(DISTINCT (entity, inserted)) AS n_episodes, count(*) AS n_rows, count(*) FILTER (WHERE is_decision) AS n_decisions, sum(outcome_in)::BIGINT AS n_outcomes, count(*) FILTER (WHERE death_in = 1) AS n_deaths, round(avg(hours_in), 6) AS mean_hours_in FROM panel")
def overview(spark, folder):
    return rounded(base(spark, folder).agg(F.count_distinct("entity").alias("n_entities"), F.count_distinct(F.struct(*EPISODE)).alias("n_episodes"), F.count("*").alias("n_rows"), F.count_if("is_decision").alias("n_decisions"), F.sum("outcome_in").alias("n_outcomes"), F.count_if(F.col("death_in") == 1).alias("n_deaths"), F.avg("hours_in").alias("mean_hours_in")))


@query(f"WITH {oracle.PANEL} SELECT entity, inserted, count(*) AS n_rows, max(outcome_in)::INT AS any_outcome, max(death_in)::INT AS any_death, sum(hours_in) FILTER (WHERE state = 'in') > 48 AS long_exposure, max(periods_in_state) FILTER (WHERE state = 'in') AS periods_in, coalesce(max(periods_in_state) FILTER (WHERE state = 'out'), 0) AS periods_out, round(median(hours_in), 6) AS median_hours_in FROM panel GROUP BY 1, 2")
def episode_table(spark, folder):
    inside, outside = F.col("state") == "in", F.col("state") == "out"
    return rounded(
        base(spark, folder).groupBy(*EPISODE).agg(
            F.count("*").alias("n_rows"),
            F.max("outcome_in").alias("any_outcome"),
            F.max("death_in").alias("any_death"),
            (F.sum(F.when(inside, F.col("hours_in"))) > 48).alias("long_exposure"),
            F.max(F.when(inside, F.col("periods_in_state"))).alias("periods_in"),
            F.coalesce(F.max(F.when(outside, F.col("periods_in_state"))), F.lit(0)).alias("periods_out"),
            F.median("hours_in").alias("median_hours_in"),
        )
    )


def hazards(rows: DataFrame) -> DataFrame:
    """Smoothed rates by state and elapsed period (five at most)."""
    return rows.groupBy(F.col("state").alias("h_state"), F.least("periods_in_state", F.lit(5)).alias("h_period")).agg(
        smoothed(F.sum(F.col("outcome_in") * F.col("at_risk_outcome")), F.sum("at_risk_outcome")).alias("h_outcome"), smoothed(F.sum("death_in"), F.count("*")).alias("h_death")
    )


def risk_rows(spark, folder) -> DataFrame:
    """The g-formula's rows: factual ones for current practice, counterfactual ones for each fixed-day policy, with hazards."""
    rows = base(spark, folder)
    h = hazards(rows)
    columns = ["policy", *EPISODE, "interval_hours", "policy_state", "hazard_outcome", "hazard_death"]
    window = (F.col("period_start") < F.col("removed") + panel.OUTCOME_WINDOW).cast("int")
    factual = rows.join(h, (F.col("h_state") == F.col("state")) & (F.col("h_period") == F.least("periods_in_state", F.lit(5)))).select(F.lit(policy.CURRENT).alias("policy"), *EPISODE, "interval_hours", F.col("state").alias("policy_state"), (F.col("h_outcome") * window).alias("hazard_outcome"), F.col("h_death").alias("hazard_death"))
    under = policy.with_policies(rows, DAYS)
    clock = F.least(F.coalesce("policy_periods_in", F.greatest("policy_periods_out", F.lit(1))), F.lit(5))
    fixed = under.join(h, (F.col("h_state") == F.col("policy_state")) & (F.col("h_period") == clock), "left").withColumn("hazard_outcome", F.when(F.coalesce("policy_periods_out", F.lit(0)) <= 2, F.col("h_outcome")).otherwise(0.0)).withColumnRenamed("h_death", "hazard_death")
    return factual.select(*columns).unionByName(fixed.select(*columns))


def risks(spark, folder) -> DataFrame:
    return policy.episode_risks(risk_rows(spark, folder), ["hazard_outcome", "hazard_death"])


VALUES = ["risk_outcome", "risk_death", "exposure_days"]


@query(f"WITH {oracle.RISKS} SELECT policy, entity, inserted, complete, n_rows, " + ", ".join(f"round({v}, 6) AS {v}" for v in VALUES) + " FROM risks")
def gformula_risks(spark, folder):
    return rounded(risks(spark, folder))


@query(
    f"WITH {oracle.SUMMARY} SELECT s.policy, s.n_entities, s.n_episodes, s.n_complete, "
    + ", ".join(f"round(s.{v}, 6) AS {v}, round(s.{v} - b.{v}, 6) AS {v}_difference, round(s.{v} / nullif(b.{v}, 0), 6) AS {v}_ratio" for v in VALUES)
    + " FROM summ s, (SELECT * FROM summ WHERE policy = 'current_practice') b"
)
def policy_contrasts(spark, folder):
    return rounded(policy.contrasts(policy.summary(risks(spark, folder), VALUES), VALUES))


@query(f"WITH {oracle.RISKS} SELECT policy, count(*) AS n_episodes, count(*) FILTER (WHERE NOT complete) AS n_incomplete, sum(n_rows)::BIGINT AS n_rows, " + ", ".join(f"round(min({v}), 6) AS least_{v}, round(max({v}), 6) AS most_{v}" for v in VALUES) + " FROM risks GROUP BY policy")
def policy_diagnostics(spark, folder):
    bounds = [f(v).alias(f"{n}_{v}") for v in VALUES for f, n in ((F.min, "least"), (F.max, "most"))]
    return rounded(risks(spark, folder).groupBy("policy").agg(F.count("*").alias("n_episodes"), F.count_if(~F.col("complete")).alias("n_incomplete"), F.sum("n_rows").alias("n_rows"), *bounds))


DECISION = "entity, inserted, episode_index, decision_period, next_index, n_linked_out, reward_outcome, reward_reinsertion, reward_death, reward_exit_alive"


@query(f"WITH {oracle.DECISIONS} SELECT {DECISION}, round(reward_exposure_days, 6) AS reward_exposure_days, round(actual_exposure_days, 6) AS actual_exposure_days FROM dec")
def decision_links(spark, folder):
    return rounded(panel.decisions(base(spark, folder)).select(*DECISION.split(", "), "reward_exposure_days", "actual_exposure_days"))


def decision_rows(spark, folder) -> DataFrame:
    """Decision rows with their entity's fold and the behaviour model's cell ``g_day``; cut, as every model and branch reads them."""
    rows = panel.decisions(base(spark, folder)).withColumn("g_day", F.least("episode_day", F.lit(6)))
    rows = rows.withColumn("action_removed", F.col("removed_in")).withColumn("reward", F.col("reward_outcome").cast("double"))
    rows = cut(rows)
    return cut(rows.join(folds.grouped_folds(rows).select("entity", "fold"), "entity"))


def scored_decisions(spark, folder) -> DataFrame:
    """``decision_rows`` with cross-fitted rate models: ``g`` of removal, ``q_keep`` and ``q_remove`` of the outcome, by day."""
    rows = decision_rows(spark, folder)
    g = rates.crossfit_rates(rows, ["g_day"], "removed_in").withColumnRenamed("p", "g")
    q = rates.by_action(rates.crossfit_rates(rows, ["g_day", "action_removed"], "reward_outcome"), ["fold", "g_day"], "action_removed")
    return rows.join(g, ["fold", "g_day"]).join(q, ["fold", "g_day"], "left")


def policy_scores(spark, folder) -> DataFrame:
    """Decision rows under each fixed-day policy with cross-fitted propensity and outcome rates, ratios and folds."""
    rows = scored_decisions(spark, folder).withColumn("d", F.explode(F.array(*map(F.lit, DAYS))))
    under = rows.select("*", F.concat(F.lit("remove_on_day_"), F.col("d").cast("string")).alias("policy"), policy.probability(F.col("episode_day"), F.col("g"), day=F.col("d")).alias("pi"))
    return under.select("*", *[c.alias(k) for k, c in policy.ratios(F.col("action_removed"), F.col("pi"), F.col("g"), 0.05).items()])


RATIO = ("policy_probability", "behaviour_probability", "ratio_raw", "ratio", "overlap", "agreement")


@query(f"WITH {oracle.SCORES} SELECT policy, entity, inserted, decision_period, clipped, " + ", ".join(f"round({c}, 6) AS {c}" for c in RATIO) + " FROM sc")
def ratio_weights(spark, folder):
    return rounded(policy_scores(spark, folder).select("policy", "entity", "inserted", "decision_period", "clipped", *RATIO))


@query(
    f"WITH RECURSIVE {oracle.SCORES}, b AS (SELECT *, qbar + ratio * (reward - q_observed) AS b, row_number() OVER (PARTITION BY policy, entity, inserted ORDER BY decision_period DESC) AS back FROM sc), "
    "fold_back AS (SELECT policy, entity, inserted, back, decision_period, b AS score FROM b WHERE back = 1 UNION ALL SELECT b.policy, b.entity, b.inserted, b.back, b.decision_period, b.b + b.ratio * f.score FROM fold_back f JOIN b ON b.policy = f.policy AND b.entity = f.entity AND b.inserted = f.inserted AND b.back = f.back + 1) "
    "SELECT policy, count(*) AS n_decisions, round(avg(score), 6) AS mean_score, round(avg(CASE WHEN decision_period = 1 THEN score END), 6) AS value FROM fold_back GROUP BY policy"
)
def recursive_values(spark, folder):
    scored = policy.recursive_scores(policy_scores(spark, folder), ["policy", *EPISODE])
    return rounded(scored.groupBy("policy").agg(F.count("*").alias("n_decisions"), F.avg("score").alias("mean_score"), F.avg(F.when(F.col("decision_period") == 1, F.col("score"))).alias("value")))


SUPPORT = ("episode_ess", "entity_ess", "ratio_max", "cumulative_max", "cumulative_p50", "cumulative_p95", "least_behaviour_probability", "mean_agreement")


def _support_sql() -> str:
    ess = "coalesce(pow(sum({0}), 2) / nullif(sum({0} * {0}), 0), 0)"
    return (
        f"WITH {oracle.SCORES}, cum AS (SELECT *, product(ratio) OVER (PARTITION BY policy, entity, inserted ORDER BY decision_period ROWS UNBOUNDED PRECEDING) AS cr, row_number() OVER (PARTITION BY policy, entity, inserted ORDER BY decision_period DESC) AS back FROM sc), "
        "scoped AS (SELECT *, 'fold_period' AS scope, fold AS of_fold, decision_period AS of_period FROM cum UNION ALL SELECT *, 'period', NULL, decision_period FROM cum UNION ALL SELECT *, 'episode_final', NULL, NULL FROM cum WHERE back = 1), "
        "ent AS (SELECT policy, scope, of_fold, of_period, entity, sum(cr) AS w FROM scoped GROUP BY ALL), "
        f"e2 AS (SELECT policy, scope, of_fold, of_period, {ess.format('w')} AS entity_ess, count(*) FILTER (WHERE w > 0) AS n_contributing_entities, count(*) AS n_entities FROM ent GROUP BY ALL), "
        f"e1 AS (SELECT policy, scope, of_fold, of_period, count(*) AS n_episodes, count(*) FILTER (WHERE cr > 0) AS n_contributing_episodes, {ess.format('cr')} AS episode_ess, max(ratio) AS ratio_max, max(cr) AS cumulative_max, quantile_cont(cr, 0.5) AS cumulative_p50, quantile_cont(cr, 0.95) AS cumulative_p95, sum(clipped)::BIGINT AS n_clipped, min(behaviour_probability) AS least_behaviour_probability, avg(agreement) AS mean_agreement FROM scoped GROUP BY ALL) "
        "SELECT e1.policy, e1.scope, e1.of_fold, e1.of_period, n_episodes, n_contributing_episodes, n_clipped, n_contributing_entities, n_entities, "
        + ", ".join(f"round({c}, 6) AS {c}" for c in SUPPORT)
        + " FROM e1 JOIN e2 ON e1.policy = e2.policy AND e1.scope = e2.scope AND e1.of_fold IS NOT DISTINCT FROM e2.of_fold AND e1.of_period IS NOT DISTINCT FROM e2.of_period"
    )


@query(_support_sql())
def support_diagnostics(spark, folder):
    rows = policy.cumulative_ratio(policy_scores(spark, folder), ["policy", *EPISODE])
    return rounded(policy.support(rows).select("policy", "scope", "of_fold", "of_period", "n_episodes", "n_contributing_episodes", "n_clipped", "n_contributing_entities", "n_entities", *SUPPORT))


FOLDS_SQL = f"WITH {oracle.PANEL}, n AS (SELECT entity, count(*) AS n_rows FROM panel GROUP BY entity), turns AS (SELECT *, entity % 64 AS bucket, (row_number() OVER (PARTITION BY entity % 64 ORDER BY n_rows DESC, entity) - 1) % 10 AS turn FROM n) SELECT entity, n_rows, CAST((CASE WHEN turn < 5 THEN turn ELSE 9 - turn END + bucket) % 5 AS BIGINT) AS fold FROM turns"


@query(FOLDS_SQL)
def group_folds(spark, folder):
    return folds.grouped_folds(base(spark, folder))


REPLICATES, SEED = 40, 20260923


def _numbers(spark, folder) -> tuple[DataFrame, int]:
    numbers = bootstrap.entity_numbers(episodes(spark, folder))
    return numbers, numbers.count()


def replicates(spark, folder) -> DataFrame:
    numbers, n = _numbers(spark, folder)
    return bootstrap.replicate_means(bootstrap.entity_sums(risks(spark, folder), VALUES), numbers, bootstrap.draws(max(n, 1), REPLICATES, SEED, spark))


BOOT = (
    oracle.RISKS
    + ", nums AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS number, count(*) OVER () AS n_all FROM (SELECT DISTINCT entity FROM eps)), "
    + f"drawn AS (SELECT replicate, CAST(floor({oracle.uniform(SEED, 'replicate', 'draw')} * n_all) AS BIGINT) AS number, count(*) AS times FROM (SELECT unnest(range(0, {REPLICATES})) AS replicate), (SELECT number AS draw, n_all FROM nums) GROUP BY 1, 2), "
    + "sums AS (SELECT policy, entity, measure, sum(x) AS total, count(*) AS n FROM (SELECT policy, entity, unnest(['risk_outcome', 'risk_death', 'exposure_days']) AS measure, unnest([risk_outcome, risk_death, exposure_days]) AS x FROM risks) WHERE x IS NOT NULL GROUP BY ALL), "
    + "est AS (SELECT replicate, policy, measure, sum(times * total) / sum(times * n) AS estimate FROM sums JOIN nums USING (entity) JOIN drawn USING (number) GROUP BY ALL)"
)


@query(f"WITH {BOOT} SELECT replicate, policy, measure, round(estimate, 6) AS estimate FROM est")
def bootstrap_fixed(spark, folder):
    return rounded(replicates(spark, folder))


PAIRED = BOOT + ", pair AS (SELECT e.replicate, e.policy, e.measure, e.estimate - b.estimate AS estimate FROM est e JOIN est b ON b.policy = 'current_practice' AND e.replicate = b.replicate AND e.measure = b.measure WHERE e.policy <> 'current_practice')"


@query(f"WITH {PAIRED} SELECT replicate, policy, measure, round(estimate, 6) AS estimate FROM pair")
def paired_differences(spark, folder):
    return rounded(bootstrap.paired(replicates(spark, folder), policy.CURRENT))


@query(f"WITH {PAIRED} SELECT policy, measure, round(quantile_cont(estimate, 0.025), 6) AS low, round(quantile_cont(estimate, 0.975), 6) AS high, count(*) AS n, count(estimate) AS n_valid, count(*) - count(estimate) AS n_undefined FROM pair GROUP BY policy, measure")
def percentile_intervals(spark, folder):
    return rounded(bootstrap.percentile_intervals(bootstrap.paired(replicates(spark, folder), policy.CURRENT)))


CONFOUNDERS = ["episode_day", "stay_days", "start_hour"]
Z_SQL = ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS z{k + 1}" for k, c in enumerate(CONFOUNDERS))
INTERCEPT, SIM_SEED = -0.75, 20260811
_EXPIT = "1 / (1 + exp(-greatest(least({0}, 35), -35)))"
SIM = (
    oracle.PANEL
    + ", conf AS (SELECT *, (unit_out - unit_in) / 86400000000.0 AS stay_days, (inserted // 3600000000) % 24 AS start_hour FROM panel), "
    + f"std AS (SELECT *, {Z_SQL} FROM conf), "
    + f"sim0 AS (SELECT *, greatest(least({_EXPIT.format(f'0.45 * z1 + 0.7 * z2 + 0.8 * z3 + {INTERCEPT}')}, 0.95), 0.05) AS p_remove, {oracle.uniform(SIM_SEED, 'entity', 'inserted // 1000000', 'episode_index')} AS u_remove FROM std), "
    + "sim1 AS (SELECT *, min(CASE WHEN u_remove < p_remove THEN episode_index END) OVER (PARTITION BY entity, inserted) AS sim_remove_index FROM sim0), "
    + "sim AS (SELECT *, CASE WHEN sim_remove_index IS NULL OR episode_index <= sim_remove_index THEN 'in' ELSE 'out' END AS sim_state, CASE WHEN sim_remove_index IS NULL OR episode_index < sim_remove_index THEN 'keep' WHEN episode_index = sim_remove_index THEN 'remove' ELSE 'out' END AS sim_action FROM sim1)"
)
_OUTCOME = _EXPIT.format("0.4 * z1 + 0.55 * z2 + 0.75 * z3 - 2.4 + CASE WHEN {a} IN ('remove', 'out') THEN -0.9 ELSE 0 END")


def with_stay(spark, folder) -> DataFrame:
    return base(spark, folder).withColumn("stay_days", (F.col("unit_out") - F.col("unit_in")) / 8.64e10).withColumn("start_hour", F.floor(F.col("inserted") / 3_600_000_000) % 24)


def confounded(spark, folder) -> DataFrame:
    return simulate.standardised(with_stay(spark, folder), CONFOUNDERS)


@query(f"WITH {SIM} SELECT entity, inserted, episode_index, sim_remove_index, sim_state, sim_action, round(p_remove, 6) AS p_remove, round(u_remove, 6) AS u_remove FROM sim")
def sim_trajectories(spark, folder):
    return rounded(simulate.trajectories(confounded(spark, folder), INTERCEPT, SIM_SEED).select("entity", "inserted", "episode_index", "sim_remove_index", "sim_state", "sim_action", "p_remove", "u_remove"))


@query(
    f"WITH {SIM}, o1 AS (SELECT *, {_OUTCOME.format(a='sim_action')} AS p_outcome, {oracle.uniform(SIM_SEED + 1, 'entity', 'inserted // 1000000', 'episode_index')} AS u_outcome FROM sim), "
    "o2 AS (SELECT *, min(CASE WHEN u_outcome < p_outcome THEN episode_index END) OVER (PARTITION BY entity, inserted) AS f FROM o1) "
    "SELECT sim_state, sim_action, count(*) AS n, sum(CAST(coalesce(episode_index = f, false) AS INT))::BIGINT AS events, sum(CAST(coalesce(episode_index <= f, true) AS INT))::BIGINT AS at_risk, round(avg(p_outcome), 6) AS mean_p FROM o2 GROUP BY 1, 2"
)
def sim_first_events(spark, folder):
    rows = simulate.first_outcomes(simulate.trajectories(confounded(spark, folder), INTERCEPT, SIM_SEED), SIM_SEED)
    return rounded(rows.groupBy("sim_state", "sim_action").agg(F.count("*").alias("n"), F.sum("sim_outcome").alias("events"), F.sum("sim_at_risk").alias("at_risk"), F.avg("p_outcome").alias("mean_p")))


@query(
    f"WITH {SIM}, days AS (SELECT unnest([1, 2, 3, 4, 5]) AS d), under AS (SELECT 'remove_on_day_' || d AS policy, std.*, CASE WHEN episode_day < d THEN 'keep' WHEN episode_day = d THEN 'remove' ELSE 'out' END AS pa FROM std, days WHERE period_start - inserted < 14 * 86400000000), "
    f"r AS (SELECT policy, entity, inserted, 1 - product(1 - {_OUTCOME.format(a='pa')}) AS risk FROM under GROUP BY ALL) SELECT policy, round(avg(risk), 6) AS true_risk, count(*) AS n_episodes FROM r GROUP BY policy"
)
def known_policy_values(spark, folder):
    return rounded(simulate.known_values(policy.with_policies(confounded(spark, folder), DAYS), 14))


@query()
def sim_calibrated_intercept(spark, folder):
    """The intercept at which a fifth of decisions remove, and the mean probability it gives."""
    rows = cut(confounded(spark, folder).select("entity", "inserted", "episode_index", "z1", "z2", "z3"))
    a = simulate.action_intercept(rows, 0.2)
    return rounded(simulate.trajectories(rows, a, SIM_SEED).agg(F.lit(a).alias("intercept"), F.avg("p_remove").alias("mean_p_remove")))


MODEL_FEATURES = ["episode_day", "interval_hours", "stay_days", "start_hour"]


def model_rows(spark, folder) -> DataFrame:
    rows = with_stay(spark, folder).where("is_decision")
    chosen = rows.join(folds.grouped_folds(rows).select("entity", "fold"), "entity").select("entity", "inserted", "episode_index", "fold", "removed_in", "outcome_in", *[F.col(c).cast("double").alias(c) for c in MODEL_FEATURES])
    return cut(chosen)  # each fold's fit reads it several times


@query()
def crossfit_propensity(spark, folder):
    """Out-of-fold removal probabilities; each entity is scored by a model that hasn't seen it."""
    return rounded(learners.crossfit(model_rows(spark, folder), MODEL_FEATURES, "removed_in").select("entity", "inserted", "episode_index", "fold", "removed_in", "p"))


@query()
def crossfit_counterfactual(spark, folder):
    """Outcome probabilities under keep and remove, from models fitted on the observed action."""
    rows = model_rows(spark, folder).withColumn("treated", F.col("removed_in").cast("double"))
    names = [*MODEL_FEATURES, "treated"]
    both = rows.withColumn("act", F.explode(F.array(F.lit(0.0), F.lit(1.0)))).withColumn("treated", F.col("act"))
    scored = learners.crossfit(rows, names, "outcome_in", score_rows=both)
    return rounded(scored.groupBy("entity", "inserted", "episode_index", "fold").agg(F.max(F.when(F.col("act") == 0, F.col("p"))).alias("p_if_keep"), F.max(F.when(F.col("act") == 1, F.col("p"))).alias("p_if_remove")))


@query()
def crossfit_metrics(spark, folder):
    """Discrimination and calibration of the propensity, over all and by fold."""
    scored = learners.crossfit(model_rows(spark, folder), MODEL_FEATURES, "removed_in").withColumn("y", F.col("removed_in"))
    both = scored.withColumn("group", F.lit("all")).unionByName(scored.withColumn("group", F.concat(F.lit("fold_"), F.col("fold").cast("string"))))
    return rounded(metrics.binary_metrics(both))


@query()
def super_learner_weights(spark, folder):
    """Convex weights of the learners by inner out-of-fold squared error, for each of three outer folds; all learners are refitted on the outer training part."""
    rows = with_stay(spark, folder).where("is_decision")
    fold = folds.grouped_folds(rows, 3).select("entity", "fold")
    chosen = cut(rows.join(fold, "entity").select("entity", "inserted", "episode_index", "fold", "removed_in", *[F.col(c).cast("double").alias(c) for c in MODEL_FEATURES]))
    _, weights = learners.super_learner(chosen, MODEL_FEATURES, "removed_in", ["logistic", "forest"])
    return rounded(spark.createDataFrame([(k, n, w, why) for k, (by, why) in sorted(weights.items()) for n, w in by.items()], "fold bigint, learner string, weight double, fallback string"))


CLIPS = (0.01, 0.05, 0.1, 0.2)


@query(
    f"WITH {oracle.SCORES}, cl AS (SELECT sc.*, eps, policy_probability / (CASE WHEN action_removed = 1 THEN least(greatest(g, eps), 1 - eps) ELSE 1 - least(greatest(g, eps), 1 - eps) END) AS w FROM sc, (SELECT unnest([0.01, 0.05, 0.1, 0.2]) AS eps)), "
    "tm AS (SELECT *, (qbar + w * (reward - q_observed)) * coalesce(product(w) OVER (PARTITION BY policy, eps, entity, inserted ORDER BY decision_period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS term FROM cl), "
    "ep AS (SELECT policy, eps, entity, inserted, sum(term) AS v FROM tm GROUP BY ALL) SELECT policy, eps::DOUBLE AS epsilon, round(avg(v), 6) AS value, count(*) AS n FROM ep GROUP BY policy, eps"
)
def clipping_sensitivity(spark, folder):
    """Values under several clipping bounds, from the closed form of the recursion: each term times the product of the ratios before it."""
    rows = policy_scores(spark, folder).withColumn("epsilon", F.explode(F.array(*map(F.lit, CLIPS))))
    clipped = F.greatest(F.least("g", 1 - F.col("epsilon")), F.col("epsilon"))
    w = F.col("policy_probability") / F.when(F.col("action_removed") == 1, clipped).otherwise(1 - clipped)
    observed = F.when(F.col("action_removed") == 1, F.col("q_remove")).otherwise(F.col("q_keep"))
    b = (1 - F.col("pi")) * F.col("q_keep") + F.col("pi") * F.col("q_remove") + F.col("w") * (F.col("reward") - observed)
    before = F.coalesce(F.product("w").over(Window.partitionBy("policy", "epsilon", *EPISODE).orderBy("decision_period").rowsBetween(Window.unboundedPreceding, -1)), F.lit(1.0))
    terms = rows.withColumn("w", w).withColumn("term", b * before)
    return rounded(terms.groupBy("policy", "epsilon", *EPISODE).agg(F.sum("term").alias("v")).groupBy("policy", "epsilon").agg(F.avg("v").alias("value"), F.count("*").alias("n")))


@query(f"WITH {oracle.PANEL}, {oracle.HAZARDS}, saved AS (SELECT entity, inserted, episode_index, 0.25 AS p FROM panel WHERE episode_index % 2 = 0) SELECT p.entity, p.inserted, p.episode_index, round(coalesce(saved.p, h_outcome), 6) AS p, saved.p IS NOT NULL AS was_saved FROM panel p JOIN haz ON h_state = state AND h_period = least(periods_in_state, 5) LEFT JOIN saved USING (entity, inserted, episode_index)")
def filled_scores(spark, folder):
    """Saved scores where there are some, rescored ones elsewhere."""
    rows = base(spark, folder)
    scored = rows.join(hazards(rows), (F.col("h_state") == F.col("state")) & (F.col("h_period") == F.least("periods_in_state", F.lit(5)))).select(*EPISODE, "episode_index", "h_outcome")
    saved = rows.where("episode_index % 2 = 0").select(*EPISODE, "episode_index", F.lit(0.25).alias("p"))
    return rounded(attach.filled(scored, saved, [*EPISODE, "episode_index"], "p", "h_outcome").drop("h_outcome"))


@query("SELECT CAST(0 AS BIGINT) AS repeated_left, CAST(0 AS BIGINT) AS repeated_right, CAST(0 AS BIGINT) AS unmatched")
def attach_checks(spark, folder):
    rows = base(spark, folder).select(*EPISODE, "episode_index")
    return attach.attach_problems(rows, rows, [*EPISODE, "episode_index"])


@query(f"WITH {oracle.POLICY} SELECT policy, entity, inserted, episode_index, coalesce(policy_periods_in, 0) AS o_periods_in, coalesce(policy_periods_out, 0) AS o_periods_out, CAST(policy_action = 'remove' AS INT) AS o_removed_in, policy_reinsertion_periods AS o_reinsertion_periods FROM pol")
def policy_overrides(spark, folder):
    """The features that a model of the outcome takes under each policy in place of the observed ones."""
    rows = policy.with_policies(base(spark, folder), DAYS)
    zero = F.lit(0).cast("bigint")
    return rows.select("policy", *EPISODE, "episode_index", F.coalesce("policy_periods_in", zero).alias("o_periods_in"), F.coalesce("policy_periods_out", zero).alias("o_periods_out"), (F.col("policy_action") == "remove").cast("int").alias("o_removed_in"), F.col("policy_reinsertion_periods").alias("o_reinsertion_periods"))


@query("SELECT CAST(0 AS BIGINT) AS n_shared")
def fold_leakage(spark, folder):
    """Entities on both sides of any fold's split: none."""
    rows = base(spark, folder)
    fold = folds.grouped_folds(rows)
    return attach.overlap(fold.where("fold = 0"), fold.where("fold <> 0"), "entity").agg(F.count("*").alias("n_shared"))


@query()
def feature_importance(spark, folder):
    """Mean absolute standardised coefficients of the cross-fitted propensity."""
    return rounded(learners.importances(model_rows(spark, folder), MODEL_FEATURES, "removed_in").select("feature", F.col("importance").alias("mean_abs")))


@query()
def calibration_line(spark, folder):
    """Intercept and slope of the calibration of a rate model's hazards."""
    rows = base(spark, folder)
    scored = cut(rows.where("at_risk_outcome = 1").join(hazards(rows), (F.col("h_state") == F.col("state")) & (F.col("h_period") == F.least("periods_in_state", F.lit(5)))).select(F.col("outcome_in").alias("y"), F.col("h_outcome").alias("p")))
    found = learners.calibration_line(scored)
    return rounded(spark.createDataFrame([found] if found else [], "intercept double, slope double"))
