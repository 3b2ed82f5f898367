"""Reports on rows where each fault and each missing value occurs."""

from pyspark.sql import functions as F

from chronopanel.functions.stats import effective_size, positive_effective_size
from chronopanel.operators import features, learners, reports
from chronopanel.sources import tables

DAY = 86_400_000_000
ROWS = "policy string, policy_day bigint, entity long, inserted long, episode_day long, policy_state string, policy_action string, extra_row_out int, start long, end long, p_a double, p_b double"


def test_each_fault_of_a_policy_is_counted(spark):
    rows = [
        ("day_2", 2, 1, 0, 1, "in", "keep", 0, 0, DAY, 0.5, 0.1),
        ("day_2", 2, 1, 0, 2, "in", "remove", 0, DAY, 2 * DAY, 1.5, None),  # above 1, missing
        ("day_2", 2, 1, 0, 2, "in", "remove", 1, 2 * DAY, 10 * DAY, -0.5, 0.2),  # a repeated day, a second removal, eight days long, below 0
        ("day_2", 2, 1, 9, 1, "in", "keep", None, DAY, DAY, 0.5, 0.3),  # empty; its episode never reaches day 2
        ("day_2", 2, 2, 0, 2, "out", "out", 0, DAY, None, 0.4, 0.2),  # reaches the day, doesn't remove, no end
        ("seen", None, 2, 0, 1, "in", "remove", 0, 0, DAY, None, None),
    ]
    known = reports.with_durations(spark.createDataFrame(rows, ROWS), "start", "end")
    got = {r.policy: r.asDict() for r in reports.policy_diagnostics(known, ["a", "b"], ["entity", "inserted"]).collect()}
    one = got["day_2"]
    want = dict(
        n_rows=5, n_episodes=3, n_entities=2, n_in_rows=4, n_out_rows=1, n_remove_rows=2, n_episodes_reaching_day=2, n_removal_shortfall=0, n_episodes_several_removals=1, n_extra_rows_out=1, n_repeated_day_rows=2,
        n_episodes_in_too_long=1, n_bad_durations=2, n_long_durations=1, n_missing_a=0, n_missing_b=1, n_complete_episodes=2, n_incomplete_episodes=1, n_a_below_0=1, n_a_above_1=1, n_b_below_0=0, n_predictions_below_0=1,
        n_predictions_above_1=1, least_a=-0.5, most_a=1.5, least_b=0.1, most_b=0.3, policy_type="fixed_day",
    )
    assert {k: one[k] for k in want} == want
    assert abs(one["mean_in_rows"] - 4 / 3) < 1e-12 and abs(one["mean_exposure_days"] - 10 / 3) < 1e-12
    seen = got["seen"]
    assert (seen["policy_type"], seen["n_removal_shortfall"], seen["n_episodes_reaching_day"], seen["n_episodes_in_too_long"], seen["least_a"], seen["n_missing_a"]) == ("observed", None, 0, 0, None, 1)
    assert reports.policy_diagnostics(known.where("false"), ["a", "b"], ["entity", "inserted"]).count() == 0


PANEL = "entity long, stay long, inserted long, episode_index int, period_end long, state string, is_decision boolean, periods_in_state int, interval_hours double, outcome_in int, reinsertion_in int, at_risk_outcome int, at_risk_reinsertion int, age double, flag int, x double"


def panel(spark):
    rows = [
        (1, 7, 0, 0, 24, "in", True, 1, 24.0, 0, 0, 1, 0, None, None, 1.0),
        (1, 7, 0, 1, 48, "in", True, 2, 24.0, 1, 0, 1, 1, 50.0, 1, 4.0),
        (1, 7, 0, 2, 72, "out", False, 1, 12.0, 0, 1, 0, 1, 60.0, 0, None),
        (1, 8, 5, 0, 99, "out", False, 1, 24.0, None, None, 0, 0, 90.0, 1, 3.0),  # never in
        (2, 9, 0, 0, 24, "in", True, 1, 6.0, None, 0, 1, 0, 40.0, None, None),
        (3, 9, 0, 0, 24, "in", True, 7, 6.0, 0, 0, 0, 0, None, 5, 2.0),
        (3, 9, 0, 1, 48, None, None, None, None, 0, 0, 0, 0, 1.0, 0, 2.0),
    ]
    return spark.createDataFrame(rows, PANEL)


def test_episode_level(spark):
    got = {(r.entity, r.inserted): r for r in reports.episode_level(panel(spark), ["entity", "inserted"], "age", "x", "flag", "x", "x", split=True).collect()}
    assert set(got) == {(1, 0), (2, 0), (3, 0)}
    r = got[1, 0]
    assert (r.age, r.exposure_days, r.in_periods, r.late_removal, r.any_outcome, r.any_reinsertion, r.decision_x, r.flag, r.risk_x, r.reinsertion_x) == (50.0, 2.0, 2, 0, 1, 1, 2.5, 1, 2.5, 4.0)
    assert (r.age_median, r.age_ge_median) == (45.0, 1.0)  # of 50, 90, 40 and 1: the first known ages
    assert (got[2, 0].any_outcome, got[2, 0].decision_x, got[2, 0].reinsertion_x, got[2, 0].flag, got[2, 0].age_ge_median) == (0, None, None, 0, 0.0)
    assert (got[3, 0].late_removal, got[3, 0].flag, got[3, 0].risk_x, got[3, 0].age) == (1, 1, None, 1.0)
    unknown = reports.episode_level(panel(spark).withColumn("age", F.lit(None).cast("double")), ["entity", "inserted"], "age", "x", "flag", "x", "x", split=True).collect()
    assert len(unknown) == 3 and all(r.age_median is None and r.age_ge_median is None for r in unknown)


def test_overviews(spark):
    rows = panel(spark)
    one = reports.cohort_overview(rows, ["entity", "stay"], ["entity", "inserted"], "age", ["inserted", "episode_index"]).first()
    assert tuple(one) == (7, 3, 2, 4, 4)
    assert tuple(reports.cohort_overview(rows.where("false"), ["entity", "stay"], ["entity", "inserted"], "age", ["inserted", "episode_index"]).first()) == (0, 0, 0, 0, 0)
    assert {r.state: tuple(r)[1:] for r in reports.state_overview(rows, ["entity", "inserted"]).collect()} == {"in": (4, 3, 3), "out": (2, 1, 2), None: (1, 1, 1)}
    sets = {"risk": (F.col("at_risk_outcome") == 1, "outcome_in"), "none": (F.lit(False), "outcome_in")}
    assert {r.analysis_set: tuple(r)[1:] for r in reports.event_overview(rows, sets).collect()} == {"risk": (3, 1, 0.5), "none": (0, 0, None)}
    assert [tuple(r) for r in reports.counts(rows, {"all": F.lit(True), "in": F.col("state") == "in"}).collect()] == [("all", 7), ("in", 4)]


def test_effective_sizes(spark):
    rows = spark.createDataFrame([("a", 2.0), ("a", 1.0), ("a", 0.0), ("b", 0.0), ("c", float("inf")), ("c", 3.0), ("c", -1.0), ("d", None)], "k string, w double")
    got = {r.k: (r.zero, r.null) for r in rows.groupBy("k").agg(effective_size(F.col("w")).alias("zero"), positive_effective_size(F.col("w")).alias("null")).collect()}
    assert got["a"] == (1.8, 1.8) and got["b"] == (0.0, None) and got["c"][1] == 1.0 and got["d"] == (0.0, None)


def test_importances_skip_constant_features_and_keep_the_largest(spark):
    rows = [(i, i % 3, float(i % 2), float(i % 7), 1.0, float(i % 3 == 0), int(i % 2 == 0 or i % 11 == 0)) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, fold int, strong double, weak double, same double, own_fold double, y int")
    for name in ("logistic", "forest"):
        got = {r.feature: r for r in learners.importances(df, ["strong", "weak", "same", "own_fold"], "y", name=name).collect()}
        assert set(got) == {"strong", "weak", "own_fold"} and got["strong"].place == 1
        assert got["own_fold"].n_folds == 2 and got["weak"].n_folds == 3  # constant where fold 0 is held out
        assert [r.feature for r in learners.importances(df, ["weak", "strong"], "y", name=name, top=1).collect()] == ["strong"]
    one_class = df.withColumn("y", F.lit(1))
    assert learners.importances(one_class, ["strong"], "y").count() == 0


def test_units_rewrite_item_and_unit_and_then_the_kept_items_stay(spark):
    rows = [(1, 10, " f", 212.0), (2, 11, None, 32.0), (3, 12, "C", 37.0), (4, 13, "F", None), (5, 13, "C", 5.0), (6, None, None, 1.0), (7, 12, None, 36.0)]
    df = spark.createDataFrame(rows, "id int, item int, unit string, value double")
    got = {r.id: tuple(r)[1:] for r in features.normalised_units(df, ("F",), (11,), 12, "C", (12,)).collect()}
    assert got == {1: (12, "C", 100.0, True), 2: (12, "C", 0.0, True), 3: (12, "C", 37.0, False), 4: (12, "C", None, True), 7: (12, None, 36.0, False)}
    assert features.normalised_units(df, ("F",), (11,), 12, "C", (13,)).count() == 1  # what became 12 isn't kept


def test_first_labels_follow_the_order_of_reading(spark):
    df = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (2, None, 3), (2, "c", 4), (None, "d", 5), (3, "f", 6), (3, "e", 6)], "item int, label string, at int")
    assert {r.item: r.label for r in tables.first_labels(df, order="at").collect()} == {1: "b", 2: None, 3: "e"}
    assert {r.item: r.label for r in tables.first_labels(df).collect()} == {1: "a", 2: "c", 3: "e"}
