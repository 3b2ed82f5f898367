"""DuckDB SQL for the event tables' episodes and panel: the common part of the oracles."""

from __future__ import annotations

EVENTS = """ev AS (SELECT user_id AS entity, event_id, event_type AS item, value, epoch_us(ts) AS t FROM events),
stay AS (SELECT entity, min(t) AS unit_in, max(t) AS unit_out, min(CASE WHEN item = 'error' AND value > 200 THEN t END) AS death FROM ev GROUP BY entity),
raw AS (SELECT entity, t AS s, t + CAST(round(value * 3600) AS BIGINT) * 1000000 AS e FROM ev WHERE item = 'signup' AND round(value * 3600) > 0)"""

MERGED = (
    EVENTS
    + """,
fresh AS (SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY entity ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS f FROM raw),
isl AS (SELECT *, sum(f) OVER (PARTITION BY entity ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM fresh),
merged AS (SELECT entity, min(s) AS inserted, max(e) AS removed, count(*) AS n_merged FROM isl GROUP BY entity, g)"""
)

EPISODES = (
    MERGED
    + """,
linked AS (SELECT m.entity, m.inserted, m.removed, unit_in, unit_out, death, lead(inserted) OVER (PARTITION BY m.entity ORDER BY inserted) AS reinsertion
  FROM merged m JOIN stay USING (entity) WHERE inserted < least(coalesce(death, unit_out), unit_out)),
ended AS (SELECT *, least(coalesce(death, unit_out), coalesce(reinsertion, unit_out), unit_out) AS episode_end FROM linked),
eps0 AS (SELECT *, CASE WHEN death = episode_end THEN 'death' WHEN reinsertion = episode_end THEN 'reinsertion' ELSE 'exit_alive' END AS end_reason
  FROM ended WHERE least(removed, episode_end) - inserted >= 86400000000),
firsts AS (SELECT e.entity, e.inserted, min(t) AS outcome FROM eps0 e JOIN ev ON ev.entity = e.entity AND item = 'purchase'
  AND t BETWEEN e.inserted AND least(e.removed + 172800000000, e.episode_end) GROUP BY 1, 2),
eps AS (SELECT eps0.*, outcome FROM eps0 LEFT JOIN firsts USING (entity, inserted))"""
)

PANEL = (
    EPISODES
    + """,
grid0 AS (SELECT *, unnest(range(0, CAST(ceil((episode_end - inserted) / 86400000000.0) AS BIGINT))) AS episode_index FROM eps),
grid AS (SELECT *, inserted + episode_index * 86400000000 AS period_start, least(inserted + (episode_index + 1) * 86400000000, episode_end) AS period_end FROM grid0),
flags AS (SELECT *, CASE WHEN period_start < removed THEN 'in' ELSE 'out' END AS state, period_start < removed AS is_decision,
  CASE WHEN period_start < removed THEN episode_index + 1 ELSE (period_start - removed) // 86400000000 + 1 END AS periods_in_state,
  CASE WHEN period_start < removed THEN 0 ELSE (period_start - removed) // 86400000000 + 1 END AS reinsertion_periods,
  (period_end - period_start) / 3600000000.0 AS interval_hours,
  greatest(least(period_end, removed, episode_end) - period_start, 0) / 3600000000.0 AS hours_in,
  CAST(period_start < removed AND removed < episode_end AND removed > period_start AND removed <= period_end AS INT) AS removed_in,
  CAST(coalesce(outcome > period_start AND outcome <= period_end, false) AS INT) AS outcome_in,
  CAST(period_end = episode_end AND end_reason = 'death' AS INT) AS death_in,
  CAST(period_end = episode_end AND end_reason = 'reinsertion' AS INT) AS reinsertion_in,
  CAST(period_end = episode_end AND end_reason = 'exit_alive' AS INT) AS exit_alive_in FROM grid),
panel AS (SELECT *, interval_hours - hours_in AS hours_out, CAST(period_start < removed + 172800000000 AND
  coalesce(sum(outcome_in) OVER (PARTITION BY entity, inserted ORDER BY episode_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS INT) AS at_risk_outcome,
  CAST(interval_hours - hours_in > 0 AS INT) AS at_risk_reinsertion,
  CASE WHEN NOT is_decision THEN 'out' WHEN removed_in = 1 THEN 'remove' ELSE 'keep' END AS action,
  greatest(unit_in, period_start - 86400000000) AS look_start, episode_index + 1 AS episode_day FROM flags)"""
)

RULES = """meas AS (SELECT entity, item, t, value FROM ev WHERE item IN ('view', 'click')),
rule0 AS (SELECT item, count(value) AS n_values, avg(CASE WHEN value = 0 THEN 1.0 ELSE 0.0 END) AS zero_fraction, quantile_cont(CASE WHEN value <> 0 THEN value END, 0.05) AS p5_nonzero FROM meas GROUP BY item),
rule1 AS (SELECT *, coalesce(n_values >= 100 AND p5_nonzero > 0 AND zero_fraction > 0 AND zero_fraction <= 0.1, false) AS zero_to_missing FROM rule0),
rule2 AS (SELECT item, count(*) AS n_used, quantile_cont(value, 0.01) AS p1, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, quantile_cont(value, 0.99) AS p99
  FROM meas JOIN rule1 USING (item) WHERE NOT (zero_to_missing AND value = 0) GROUP BY item),
rules AS (SELECT item, n_values, zero_fraction, p5_nonzero, zero_to_missing, n_used, p1 AS low_clip, p99 AS high_clip,
  p1 - 3 * greatest(q3 - q1, p99 - p1, 1e-8) AS low_delete, p99 + 3 * greatest(q3 - q1, p99 - p1, 1e-8) AS high_delete,
  CASE WHEN n_used >= 100 THEN 'ok' ELSE 'too_few_values' END AS status FROM rule1 LEFT JOIN rule2 USING (item)),
clean AS (SELECT entity, item, t, CASE WHEN status = 'ok' THEN least(greatest(value, low_clip), high_clip) ELSE value END AS value FROM meas JOIN rules USING (item)
  WHERE NOT (status = 'ok' AND ((zero_to_missing AND value = 0) OR value < low_delete OR value > high_delete)))"""

FEATURES = (
    PANEL
    + ",\n"
    + RULES
    + """,
inside AS (SELECT p.entity, p.inserted, p.episode_index, p.period_start, c.item, c.t, c.value FROM panel p JOIN clean c ON c.entity = p.entity AND c.t >= p.look_start AND c.t < p.period_start),
stats AS (SELECT entity, inserted, episode_index, item, count(value) AS "count", avg(value) AS mean, stddev_samp(value) AS std, arg_max(value, (t, value)) AS last,
  CASE WHEN count(DISTINCT t) > 1 THEN regr_slope(value, (t - period_start) / 3.6e9) END AS slope_per_hour FROM inside GROUP BY ALL)"""
)

POLICY = (
    PANEL
    + """,
pol0 AS (SELECT *, row_number() OVER (PARTITION BY policy_day, entity, inserted, episode_day ORDER BY period_start, period_end, episode_index) AS row_in_day
  FROM panel, (SELECT unnest([1, 2, 3, 4, 5])::BIGINT AS policy_day)),
pol1 AS (SELECT *, 'remove_on_day_' || policy_day AS policy, episode_day < policy_day OR (episode_day = policy_day AND row_in_day = 1) AS inside,
  CASE WHEN episode_day < policy_day THEN 'keep' WHEN episode_day = policy_day AND row_in_day = 1 THEN 'remove' ELSE 'out' END AS policy_action FROM pol0),
pol AS (SELECT *, CASE WHEN inside THEN 'in' ELSE 'out' END AS policy_state, CASE WHEN inside THEN episode_day END AS policy_periods_in, CASE WHEN NOT inside THEN episode_day - policy_day END AS policy_periods_out,
  greatest(episode_day - policy_day, 0) AS policy_reinsertion_periods, CAST(episode_day = policy_day AND row_in_day > 1 AS INT) AS extra_row_out,
  CASE WHEN is_decision THEN CASE WHEN episode_day >= policy_day THEN 'remove' ELSE 'keep' END ELSE 'out' END AS dml_action,
  is_decision AND inside AS policy_applicable,
  CASE WHEN is_decision AND inside THEN CAST(removed_in = CAST(policy_action = 'remove' AS INT) AS DOUBLE) END AS matches_today,
  coalesce(min(CASE WHEN removed_in = 1 THEN episode_day END) OVER (PARTITION BY policy_day, entity, inserted) = min(CASE WHEN policy_action = 'remove' THEN episode_day END) OVER (PARTITION BY policy_day, entity, inserted), false) AS matches FROM pol1)"""
)

HAZARDS = """haz AS (SELECT state AS h_state, least(periods_in_state, 5) AS h_period, (sum(outcome_in * at_risk_outcome) + 1) / (sum(at_risk_outcome) + 2.0) AS h_outcome,
  (sum(death_in) + 1) / (count(*) + 2.0) AS h_death FROM panel GROUP BY ALL)"""

RISKS = (
    POLICY
    + ",\n"
    + HAZARDS
    + """,
factual AS (SELECT 'current_practice' AS policy, entity, inserted, interval_hours, state AS policy_state, h_outcome * CAST(period_start < removed + 172800000000 AS INT) AS hazard_outcome, h_death AS hazard_death
  FROM panel JOIN haz ON h_state = state AND h_period = least(periods_in_state, 5)),
fixed AS (SELECT policy, entity, inserted, interval_hours, policy_state, CASE WHEN coalesce(policy_periods_out, 0) <= 2 THEN h_outcome ELSE 0 END AS hazard_outcome, h_death AS hazard_death
  FROM pol LEFT JOIN haz ON h_state = policy_state AND h_period = least(CASE WHEN inside THEN policy_periods_in ELSE greatest(policy_periods_out, 1) END, 5)),
risks AS (SELECT policy, entity, inserted, 1 - product(1 - hazard_outcome) AS risk_outcome, 1 - product(1 - hazard_death) AS risk_death,
  sum(CASE WHEN policy_state = 'in' THEN interval_hours / 24 ELSE 0 END) AS exposure_days, bool_and(hazard_outcome IS NOT NULL AND hazard_death IS NOT NULL) AS complete, count(*) AS n_rows
  FROM (SELECT * FROM factual UNION ALL SELECT * FROM fixed) GROUP BY policy, entity, inserted)"""
)

SUMMARY = (
    RISKS
    + """,
summ AS (SELECT policy, count(DISTINCT entity) AS n_entities, count(*) AS n_episodes, count(*) FILTER (WHERE complete) AS n_complete,
  avg(risk_outcome) FILTER (WHERE complete) AS risk_outcome, avg(risk_death) FILTER (WHERE complete) AS risk_death, avg(exposure_days) FILTER (WHERE complete) AS exposure_days FROM risks GROUP BY policy)"""
)

DECISIONS = (
    PANEL
    + """,
tgt AS (SELECT *, least(episode_index, max(CASE WHEN is_decision THEN episode_index END) OVER (PARTITION BY entity, inserted)) AS target FROM panel),
rew AS (SELECT entity, inserted, target AS episode_index, sum(outcome_in)::BIGINT AS reward_outcome, sum(reinsertion_in)::BIGINT AS reward_reinsertion, sum(death_in)::BIGINT AS reward_death, sum(exit_alive_in)::BIGINT AS reward_exit_alive,
  sum(CASE WHEN is_decision THEN interval_hours / 24 ELSE 0 END) AS reward_exposure_days, sum(hours_in / 24) AS actual_exposure_days, count(*) FILTER (WHERE NOT is_decision) AS n_linked_out FROM tgt GROUP BY ALL),
dec AS (SELECT p.*, reward_outcome, reward_reinsertion, reward_death, reward_exit_alive, reward_exposure_days, actual_exposure_days, n_linked_out, p.episode_index + 1 AS decision_period,
  lead(p.episode_index) OVER (PARTITION BY p.entity, p.inserted ORDER BY p.episode_index) AS next_index FROM panel p JOIN rew USING (entity, inserted, episode_index) WHERE p.is_decision)"""
)

FOLD = """fold AS (SELECT entity, CAST((CASE WHEN turn < 5 THEN turn ELSE 9 - turn END + bucket) % 5 AS BIGINT) AS fold FROM (SELECT entity, entity % 64 AS bucket,
  (row_number() OVER (PARTITION BY entity % 64 ORDER BY n_rows DESC, entity) - 1) % 10 AS turn FROM (SELECT entity, count(*) AS n_rows FROM {rows} GROUP BY entity)))"""


def crossfit(name: str, rows: str, cell: dict[str, str], y: str, where: str = "true") -> str:
    """The rate of y in each cell for each fold, from the other folds, with one event and one non-event added."""
    keys = ", ".join(cell)
    return (
        f"{name}_own AS (SELECT fold, {', '.join(f'{e} AS {k}' for k, e in cell.items())}, count(*) AS n, sum({y}) AS e FROM {rows} WHERE {where} GROUP BY ALL), "
        f"{name} AS (SELECT f.fold, {', '.join(f't.{k}' for k in cell)}, (t.e - coalesce(o.e, 0) + 1) / (t.n - coalesce(o.n, 0) + 2.0) AS p FROM (SELECT {keys}, sum(n) AS n, sum(e) AS e FROM {name}_own GROUP BY ALL) t "
        f"CROSS JOIN (SELECT unnest(range(0, 5)) AS fold) f LEFT JOIN {name}_own o ON o.fold = f.fold AND {' AND '.join(f'o.{k} = t.{k}' for k in cell)})"
    )


SCORES = (
    DECISIONS
    + ",\n"
    + FOLD.format(rows="dec")
    + """,
decf AS (SELECT dec.*, fold FROM dec JOIN fold USING (entity)),
"""
    + crossfit("prop", "decf", {"g_day": "least(episode_day, 6)"}, "removed_in")
    + ",\n"
    + crossfit("qrate", "decf", {"q_day": "least(episode_day, 6)", "q_action": "removed_in"}, "reward_outcome")
    + """,
sc0 AS (SELECT 'remove_on_day_' || d AS policy, decf.*, removed_in AS action_removed, prop.p AS g, CAST(episode_day >= d AS DOUBLE) AS pi, coalesce(q0.p, 0.5) AS q_keep, coalesce(q1.p, 0.5) AS q_remove, CAST(reward_outcome AS DOUBLE) AS reward
  FROM decf JOIN prop ON g_day = least(episode_day, 6) AND prop.fold = decf.fold LEFT JOIN qrate q0 ON q0.q_day = least(episode_day, 6) AND q0.fold = decf.fold AND q0.q_action = 0
  LEFT JOIN qrate q1 ON q1.q_day = least(episode_day, 6) AND q1.fold = decf.fold AND q1.q_action = 1, (SELECT unnest([1, 2, 3, 4, 5]) AS d)),
sc1 AS (SELECT *, CASE WHEN action_removed = 1 THEN pi ELSE 1 - pi END AS policy_probability, CASE WHEN action_removed = 1 THEN g ELSE 1 - g END AS behaviour_probability,
  least(greatest(g, 0.05), 0.95) AS g_used FROM sc0),
sc AS (SELECT *, policy_probability / (CASE WHEN action_removed = 1 THEN g_used ELSE 1 - g_used END) AS ratio, policy_probability / behaviour_probability AS ratio_raw,
  CAST(behaviour_probability <> (CASE WHEN action_removed = 1 THEN g_used ELSE 1 - g_used END) AS INT) AS clipped, pi * g + (1 - pi) * (1 - g) AS overlap,
  CAST(action_removed = pi AS DOUBLE) AS agreement, (1 - pi) * q_keep + pi * q_remove AS qbar, CASE WHEN action_removed = 1 THEN q_remove ELSE q_keep END AS q_observed FROM sc1)"""
)


def uniform(seed: int, *ids: str) -> str:
    """The generator of ``functions.stats.uniform``."""
    x = f"CAST({seed} AS BIGINT)"
    for k in ids:
        x = f"(((({k}) % 2147483648 + {x} * 31 + 17) % 2147483648 * 1103515245 + 12345) % 2147483648)"
    return f"((({x}) * 1103515245 + 12345) % 2147483648 / 2147483648.0)"
