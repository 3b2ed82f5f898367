"""Hand-computed cases of the longitudinal operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.functions.stats import any_event, effective_size, uniform
from chronopanel.functions.text import grouped
from chronopanel.functions.time import HOUR, floor_div
from chronopanel.operators import bootstrap, features, folds, intervals, learners, metrics, panel, policy, simulate
from chronopanel.plans import longitudinal
from chronopanel.sources import sinks, tables

START = 1_704_088_800_000_000


def at(hours):
    return None if hours is None else START + int(hours * HOUR)


def episode(spark, removed, out, reinsertion=None, death=None, outcome=None):
    rows = [(1, START, at(removed), START, at(out), at(death), at(reinsertion), at(outcome))]
    df = spark.createDataFrame(rows, "entity long, inserted long, removed long, unit_in long, unit_out long, death long, reinsertion long, outcome long")
    end, reason = intervals.first_endpoint(panel.ENDPOINTS)
    return panel.base_panel(df.withColumn("episode_end", end).withColumn("end_reason", reason))


def grid(rows):
    return [((r.period_start - START) / HOUR, (r.period_end - START) / HOUR, r.state, r.periods_in_state, r.hours_in, r.hours_out) for r in sorted(rows.collect(), key=lambda r: r.episode_index)]


def test_removal_inside_a_period(spark):
    rows = episode(spark, 38, 110)
    assert grid(rows) == [(0, 24, "in", 1, 24, 0), (24, 48, "in", 2, 14, 10), (48, 72, "out", 1, 0, 24), (72, 96, "out", 2, 0, 24), (96, 110, "out", 3, 0, 14)]
    assert [r.removed_in for r in rows.orderBy("episode_index").collect()] == [0, 1, 0, 0, 0]
    assert all(v == 0 for v in panel.violations(rows).first())


def test_reinsertion_in_the_removal_period(spark):
    rows = episode(spark, 38, 110, reinsertion=42).orderBy("episode_index").collect()
    assert len(rows) == 2 and (rows[-1].hours_in, rows[-1].hours_out, rows[-1].at_risk_reinsertion, rows[-1].final_reason) == (14, 4, 1, "reinsertion")


def test_removal_on_a_boundary_belongs_to_the_period_before(spark):
    rows = episode(spark, 48, 110).orderBy("episode_index").collect()
    assert [r.removed_in for r in rows] == [0, 1, 0, 0, 0] and rows[1].hours_out == 0


def test_equal_endpoints_resolve_in_order(spark):
    assert episode(spark, 38, 60, reinsertion=60, death=60).where("final_reason IS NOT NULL").first().final_reason == "death"
    assert episode(spark, 38, 60, reinsertion=60).where("final_reason IS NOT NULL").first().final_reason == "reinsertion"


def test_risk_window_is_elapsed_time_and_ends_after_the_first_event(spark):
    risk = [r.at_risk_outcome for r in episode(spark, 12, 120).orderBy("episode_index").collect()]
    assert risk == [1, 1, 1, 0, 0]
    risk = [r.at_risk_outcome for r in episode(spark, 40, 120, outcome=20).orderBy("episode_index").collect()]
    assert risk == [1, 0, 0, 0, 0]


def test_merge_intervals(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 8, 9), (1, 1, 2), (2, 3, 4), (2, 4, 4), (3, None, 9)], "entity long, start long, end long")
    for width in (1, 2, 1000):
        got = sorted(tuple(r) for r in intervals.merge_intervals(df, ["entity"], width).collect())
        assert got == [(1, 0, 7, 3), (1, 8, 9, 1), (2, 3, 4, 1)]


def test_empty_spans_give_no_periods(spark):
    df = spark.createDataFrame([(1, 5, 5), (2, 9, 5), (3, 0, 1)], "entity long, a long, b long")
    assert [r.entity for r in intervals.to_grid(df, "a", "b", 10).collect()] == [3]


def test_lookback_excludes_what_comes_later(spark):
    rows = episode(spark, 90, 110)
    t = [(1, "x", at(23.9), 2.0), (1, "x", at(1), 4.0), (1, "x", at(24), 99.0), (1, "x", at(-1), 77.0), (1, "x", at(0), 3.0)]
    stats = features.lookback(spark.createDataFrame(t, "entity long, item string, t long, value double"), rows)
    one = stats.where("episode_index = 1").first()
    assert (one["count"], one["mean"], one["last"]) == (3, 3.0, 2.0)
    two = stats.where("episode_index = 2").first()
    assert (two["count"], two["last"], two["std"]) == (1, 99.0, None)


def test_cleaning_rules(spark):
    values = [(1, "a", float(v)) for v in range(1, 201)] + [(1, "a", 0.0)] * 5 + [(1, "a", 1e6)] + [(1, "b", 5.0)] * 3
    df = spark.createDataFrame(values, "entity long, item string, value double")
    rules = {r["item"]: r for r in features.fit_rules(df).collect()}
    assert rules["a"].zero_to_missing and rules["a"].status == "ok" and rules["b"].status == "too_few_values"
    clean = [r.value for r in features.apply_rules(df, features.fit_rules(df)).where("item = 'a'").collect()]
    assert 0.0 not in clean and 1e6 not in clean and min(clean) == pytest.approx(rules["a"].low_clip)
    assert features.apply_rules(df, features.fit_rules(df)).where("item = 'b'").count() == 3


def test_recursion_of_three_stages(spark):
    rows = [("p", 1, 1, 0.1, 0.3, 0.2, 0, 0.0, 2.0), ("p", 1, 2, 0.2, 0.5, 0.4, 0, 1.0, 0.0), ("p", 1, 3, 1.0, 0.1, 0.2, 1, 1.0, 1.5)]
    df = spark.createDataFrame(rows, "policy string, entity long, decision_period long, reward double, q_keep double, q_remove double, action_removed int, pi double, ratio double")
    got = [r.score for r in policy.recursive_scores(df, ["policy", "entity"]).orderBy("decision_period").collect()]
    assert got == pytest.approx([0.7, 0.4, 1.4])


def test_ratios(spark):
    df = spark.createDataFrame([(0, 0.0, 0.25), (1, 0.0, 0.25), (1, 1.0, 0.01)], "a int, pi double, g double")
    r = df.select(*[c.alias(k) for k, c in policy.ratios(F.col("a"), F.col("pi"), F.col("g"), 0.05).items()]).collect()
    assert [x.ratio for x in r] == pytest.approx([1 / 0.75, 0, 20]) and [x.ratio_raw for x in r] == pytest.approx([1 / 0.75, 0, 100])


def test_effective_size_and_any_event(spark):
    df = spark.createDataFrame([(0.0, 0.5), (1.0, None), (3.0, 0.2)], "w double, p double")
    assert df.agg(effective_size(F.col("w"))).first()[0] == pytest.approx(1.6)
    assert df.agg(effective_size(F.col("w") * 0)).first()[0] == 0
    assert df.agg(any_event(F.col("p"))).first()[0] == pytest.approx(1 - 0.5 * 0.8)


def test_policy_timeline(spark):
    rows = policy.with_policies(episode(spark, 38, 110), [2]).orderBy("episode_index").collect()
    assert [r.policy_action for r in rows] == ["keep", "remove", "out", "out", "out"]
    assert [r.policy_periods_in for r in rows] == [1, 2, None, None, None] and [r.policy_periods_out for r in rows] == [None, None, 1, 2, 3]
    assert all(r.matches for r in rows) and [r.matches_today for r in rows] == [1.0, 1.0, None, None, None]


def test_decisions_take_up_what_follows(spark):
    rows = panel.decisions(episode(spark, 38, 110, outcome=70)).orderBy("episode_index").collect()
    assert [(r.reward_outcome, r.reward_exit_alive, r.n_linked_out, r.next_index) for r in rows] == [(0, 0, 0, 1), (1, 1, 3, None)]


def test_binary_metrics_with_ties(spark):
    rng = np.random.default_rng(1)
    y, p = rng.integers(0, 2, 300), rng.integers(0, 20, 300) / 20
    got = metrics.binary_metrics(spark.createDataFrame([("g", int(a), float(b)) for a, b in zip(y, p)], "group string, y int, p double")).first()
    wins = np.mean([(a > b) + 0.5 * (a == b) for a in p[y == 1] for b in p[y == 0]])
    assert got.auc == pytest.approx(wins) and got.brier == pytest.approx(((p - y) ** 2).mean())
    one = metrics.binary_metrics(spark.createDataFrame([("g", 1, 0.5)], "group string, y int, p double")).first()
    assert one.auc is None and one.average_precision == 1


def test_adjusted_p_values(spark):
    p = [0.01, 0.04, 0.03, 0.5]
    got = {r["item"]: r.q_value for r in metrics.adjusted(spark.createDataFrame([(str(k), x) for k, x in enumerate(p)], "item string, p_value double")).collect()}
    assert [got[str(k)] for k in range(4)] == pytest.approx([0.04, 0.04 * 4 / 3, 0.04 * 4 / 3, 0.5])


def test_fisher_and_chi_squared():
    assert metrics.fisher_exact(3, 1, 1, 3) == pytest.approx(0.4857142857, abs=1e-9)
    assert metrics.chi_squared_p(3.841458820694124) == pytest.approx(0.05)


def test_folds_keep_entities_whole(spark):
    df = spark.range(1000).select((F.col("id") % 97).alias("entity"))
    f = folds.grouped_folds(df, 5)
    assert f.count() == 97 and f.agg(F.count_distinct("fold")).first()[0] == 5
    assert folds.fold_violations(df.join(f, "entity")).first()[0] == 0
    sizes = [r["n"] for r in f.groupBy("fold").agg(F.sum("n_rows").alias("n")).collect()]
    assert max(sizes) < 2 * min(sizes)


def test_draws_reproduce_and_sum_up(spark):
    d = bootstrap.draws(30, 5, 7, spark)
    assert {r["s"] for r in d.groupBy("replicate").agg(F.sum("times").alias("s")).collect()} == {30}
    again = bootstrap.draws(30, 5, 7, spark).repartition(3)
    assert d.exceptAll(again).count() == 0


def test_weighted_replicates_equal_copies(spark):
    risks = spark.createDataFrame([("a", k % 7, float(k)) for k in range(20)], "policy string, entity long, v double")
    numbers, drawn = bootstrap.entity_numbers(risks), bootstrap.draws(7, 3, 1, spark)
    got = {r.replicate: r.estimate for r in bootstrap.replicate_means(bootstrap.entity_sums(risks, ["v"]), numbers, drawn).collect()}
    copies = risks.join(numbers, "entity").join(drawn, "number").withColumn("c", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    want = {r.replicate: r.m for r in copies.groupBy("replicate").agg(F.avg("v").alias("m")).collect()}
    assert got == pytest.approx(want)


def test_simplex_weights_prefer_the_better_learner():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 500).astype(float)
    x = np.column_stack([0.8 * y + 0.1, rng.random(500)])
    w = learners.simplex_weights(x.T @ x / 500, x.T @ y / 500)
    assert w.sum() == pytest.approx(1) and w.min() >= 0 and w[0] > 0.9


def test_ridge_recovers_a_line(spark):
    rows = [("a", k % 2, float(k), 3.0 + 2.0 * k) for k in range(200)]
    df = spark.createDataFrame(rows, "g string, fold long, x double, y double")
    beta = learners.ridge(df, ["x"], "y", 1e-9)
    assert beta == pytest.approx([3, 2], rel=1e-5)


def test_crossfit_falls_back_on_one_class(spark):
    df = spark.createDataFrame([(k % 3, 0, float(k)) for k in range(12)], "fold long, y int, x double")
    assert {round(r.p, 6) for r in learners.crossfit(df, ["x"], "y").collect()} == {round(1 / 10, 6)}


def test_simulated_removal_is_a_first_success(spark):
    rows = simulate.standardised(episode(spark, 200, 260), ["episode_day", "hours_in", "interval_hours"])
    out = simulate.trajectories(rows, 0.0, 3).orderBy("episode_index").collect()
    first = next((r.episode_index for r in out if r.u_remove < r.p_remove), None)
    assert all(r.sim_remove_index == first for r in out)
    assert [r.sim_action for r in out] == ["keep" if first is None or r.episode_index < first else "remove" if r.episode_index == first else "out" for r in out]


def test_uniform_spreads(spark):
    r = spark.range(20000).select(uniform(1, F.col("id")).alias("u")).agg(F.avg("u"), F.min("u"), F.max("u")).first()
    assert abs(r[0] - 0.5) < 0.02 and r[1] >= 0 and r[2] < 1


def test_floor_division_of_negatives(spark):
    assert spark.range(1).select(floor_div(F.lit(-90), 24)).first()[0] == -4


def test_groups_by_rules(spark):
    df = spark.createDataFrame([(" white \n other",), ("ASIAN - x",), ("unknown",), (None,), ("zz",)], "x string")
    got = [r[0] for r in df.select(grouped(F.col("x"), [("White", ("WHITE",)), ("Asian", ("ASIAN",))], ("UNKNOWN",), "Other")).collect()]
    assert got == ["White", "Asian", None, None, "Other"]


def test_sinks_and_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 0.12345), (2, 2, 1.0)], "entity long, policy_day long, x double")
    sinks.policy_panels(df, f"{tmp_path}/panels")
    assert tables.policy_collection(spark, f"{tmp_path}/panels").where("policy_day = 2").count() == 1
    sinks.dataset(df, f"{tmp_path}/csv", "csv")
    assert tables.csv(spark, f"{tmp_path}/csv", "entity long, policy_day long, x double").count() == 2
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        sinks.dataset(df, f"{tmp_path}/csv", "csv")
    assert sinks.report(df, 2).first().x == 0.12


def test_streaming_lookback(spark, tmp_path):
    from chronopanel.streaming.lookback import sliding_stats

    spark.createDataFrame([(1, "a", "2024-01-01 01:00:00", 2.0), (1, "a", "2024-01-01 02:00:00", 4.0), (1, "a", "2024-01-05 02:00:00", 9.0)], "entity long, item string, ts string, value double").selectExpr("entity", "item", "cast(ts AS timestamp) AS ts", "value").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("entity long, item string, ts timestamp, value double").parquet(f"{tmp_path}/in")
    q = sliding_stats(stream).writeStream.format("memory").queryName("sliding").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["count"], r["mean"]) for r in spark.sql("SELECT * FROM sliding").collect()] == [(2, 3.0)]
