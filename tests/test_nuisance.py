"""Nested recursion, nested stacking, checks: brute force, leakage and refusals."""

from functools import reduce

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.operators import bootstrap, checks, folds, learners, metrics, nested, policy, rates
from chronopanel.sources import sinks, tables

MEASURES = ["a", "b", "c", "d", "e"]
FEATURES = ["f0", "f1", "f2", "f3", "f4"]
POLICIES = [("late", 3, None, 0.05), ("coin", None, 0.3, 0.1), ("as_seen", None, None, 0.2)]
SCHEMA = "entity long, inserted long, fold long, decision_period long, day int, cell int, action_removed int, " + ", ".join(f"{c} double" for c in (*FEATURES, *(f"reward_{m}" for m in MEASURES), *(f"risk_{m}" for m in MEASURES)))


def trajectories(seed=3, entities=40, most=5):
    """One feature is constant, one repeats another but for scale, one is large; the first measure has a risk set."""
    draw, rows = np.random.default_rng(seed), []
    for entity in range(entities):
        for stage in range(1, 2 + entity % most):
            x = [float(24 - entity % 5), 7.0, float(draw.normal()), 1e6 + float(draw.normal()), float(48 - 2 * (entity % 5))]
            rows.append((entity, 7 * entity, entity // 5 % 4, stage, stage, stage % 3, int(draw.integers(2)), *x, *(float(draw.uniform() + stage * k) for k in range(5)), float(entity % 6 != 0 or stage < 2), 1.0, 1.0, 1.0, 1.0))
    return rows


def ridge(rows, y, times):
    x = np.array([[*r[7:12], r[6]] for r in rows], float)
    w = np.array([times[r[0]] for r in rows], float)
    mean = w @ x / w.sum()
    sd = np.sqrt(w @ (x - mean) ** 2 / w.sum())
    live = sd > 1e-6
    z = (x - mean) / np.where(live, sd, 1) * live
    beta = np.linalg.solve(z.T @ (z * w[:, None]) + np.eye(6), z.T @ (w * (y - w @ y / w.sum()))) / np.where(live, sd, 1) * live
    return [w @ y / w.sum() - beta @ mean, *beta]


def removal_rates(rows, times):
    return lambda cell: (sum(times[r[0]] * r[6] for r in rows if r[5] == cell) + 1) / (sum(times[r[0]] for r in rows if r[5] == cell) + 2)


def step(r, m, policy_, g, beta, after):
    _, day, chance, bound = policy_
    pi = float(r[4] >= day) if day is not None else chance if chance is not None else g
    used = min(max(g, bound), 1 - bound)
    ratio = pi / used if r[6] else (1 - pi) / (1 - used)
    keep, remove = (r[17 + m] * (beta[0] + np.dot(beta[1:-1], r[7:12]) + a * beta[-1]) if beta is not None else 0.0 for a in (0, 1))
    return (1 - pi) * keep + pi * remove + ratio * (r[12 + m] + after - (remove if r[6] else keep))


def backward(train, predict, m, p, times):
    """Scores of ``predict`` by models of ``train``, whose own fitted scores are its targets; the behaviour model is of ``train`` too."""
    own, out, g = {}, {}, removal_rates(train, times)
    for t in sorted({r[3] for r in train + predict}, reverse=True):
        now = [r for r in train if r[3] == t]
        used = [r for r in now if r[17 + m] > 0]
        beta = ridge(used, np.array([r[12 + m] + own.get((r[0], t + 1), 0.0) for r in used]), times) if used else None
        own |= {(r[0], t): step(r, m, p, g(r[5]), beta, own.get((r[0], t + 1), 0.0)) for r in now}
        out |= {(r[0], t): step(r, m, p, g(r[5]), beta, out.get((r[0], t + 1), 0.0)) for r in predict if r[3] == t}
    return out


def brute_force(rows, times=None, n_folds=4):
    times = times or {r[0]: 1 for r in rows}
    of, scores = [r for r in rows if times.get(r[0])], {}
    for p in POLICIES:
        for m, name in enumerate(MEASURES):
            for k in range(n_folds):
                rest, later = [r for r in of if r[2] != k], {}
                for j in {r[2] for r in rest}:
                    later |= backward([r for r in rest if r[2] != j], [r for r in rest if r[2] == j], m, p, times)
                done, g = {}, removal_rates(rest, times)
                for t in sorted({r[3] for r in of}, reverse=True):
                    used = [r for r in rest if r[3] == t and r[17 + m] > 0]
                    beta = ridge(used, np.array([r[12 + m] + later.get((r[0], t + 1), 0.0) for r in used]), times) if used else None
                    done |= {(r[0], t): step(r, m, p, g(r[5]), beta, done.get((r[0], t + 1), 0.0)) for r in of if r[2] == k and r[3] == t}
                scores |= {(p[0], name, *x): v for x, v in done.items()}
    return scores


def nested_of(spark, rows, **options):
    found = nested.nested_scores(spark.createDataFrame(rows, SCHEMA), ["entity", "inserted"], FEATURES, POLICIES, MEASURES, 4, **options)
    return {(r.policy, r.measure, r.entity, r.decision_period): r for r in found.collect()}


@pytest.mark.parametrize("stretch", [16, 2, 1])
def test_nested_scores_by_brute_force(spark, stretch):
    """Five features and five measures; running scores that are written every few stages change nothing."""
    rows = trajectories()
    got, want = nested_of(spark, rows, stretch=stretch), brute_force(rows)
    assert got.keys() == want.keys() and len({k[3] for k in got}) == 5
    assert all(got[k].score == pytest.approx(want[k], rel=1e-6, abs=1e-6) for k in want)


def test_nested_models_never_see_the_fold(spark):
    """Other rewards, features or actions in fold 0 leave its continuation models and its behaviour model as they are."""
    rows = trajectories()
    got = nested_of(spark, rows)
    last = {(r[0], r[3]) for r in rows} - {(r[0], r[3] - 1) for r in rows}

    def changed(change):
        return nested_of(spark, [change(r) if r[2] == 0 else r for r in rows])

    richer = changed(lambda r: (*r[:12], *(x + 1000.0 for x in r[12:17]), *r[17:]))
    acted = changed(lambda r: (*r[:6], 1 - r[6], *r[7:]))
    for k, r in got.items():
        if r.fold == 0:
            for other in (richer, acted):
                for c in ("q_keep", "q_remove", "pi", "g"):
                    assert other[k][c] == pytest.approx(r[c], rel=1e-7, abs=1e-7)
            if k[2:] in last:
                assert richer[k].score - r.score == pytest.approx(1000.0 * r.ratio, rel=1e-6)
    assert any(abs(acted[k].g - r.g) > 1e-4 for k, r in got.items() if r.fold)


def test_periods_without_support_are_refused(spark):
    rows = trajectories()
    for lost in ({0, 1, 2}, {0, 1}):  # without an outer fold's support, or an inner one's
        with pytest.raises(ValueError, match=r"no training trajectories at decision periods \[5\]"):
            nested_of(spark, [r for r in rows if r[3] < 5 or r[2] not in lost])
    at_risk = [(*r[:17], 0.0 if r[3] == 4 and r[2] else r[17], *r[18:]) for r in rows]
    with pytest.raises(ValueError, match=r"\[4\]"):
        nested_of(spark, at_risk)
    frame = spark.createDataFrame(at_risk, SCHEMA)
    assert nested.supported(frame, MEASURES) == 3 and nested.supported(frame, MEASURES[1:]) == 5 and nested.supported(frame.limit(0), MEASURES) == 0
    assert nested_of(spark, at_risk, strict=False).keys() == brute_force(at_risk).keys()
    assert nested_of(spark, []) == {}


def test_refitted_replicates_are_those_of_copied_entities(spark):
    """Multiplicities as weights give what physical copies would; one replicate draws everything once."""
    rows = trajectories()
    draw = np.random.default_rng(9)
    times = {e: [1, *(int(x) for x in draw.multinomial(1, [0.3, 0.3, 0.4]) @ [[0], [1], [3]]), 2] for e in range(40)}
    table = spark.createDataFrame([(e, t) for e, t in times.items() if e != 3], "entity long, times array<int>")
    rows_df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.replicate, r.policy, r.measure): r for r in nested.nested_bootstrap(rows_df, ["entity", "inserted"], FEATURES, POLICIES, MEASURES, table, 3, 4, strict=False).collect()}
    for k in range(3):
        of = {e: t[k] for e, t in times.items() if e != 3}
        want = brute_force([r for r in rows if r[0] != 3], of)
        for p, *_ in POLICIES:
            for m in MEASURES:
                firsts = [(of[e], v) for (p_, m_, e, t), v in want.items() if (p_, m_, t) == (p, m, 1)]
                assert got[k, p, m].n == sum(w for w, _ in firsts)
                assert got[k, p, m].value == pytest.approx(sum(w * v for w, v in firsts) / sum(w for w, _ in firsts), rel=1e-6)


def test_fits_are_recorded(spark):
    episodes, d = nested.prepared(spark.createDataFrame(trajectories(), SCHEMA), ["entity", "inserted"], FEATURES, POLICIES, MEASURES, 4, 1.0, None, 1)
    records = nested.fit(episodes, d).records
    assert len(records) == 1 + 5 * (6 + 4) and all(r[-1] >= 0 for r in records)
    rows = trajectories()
    for component, period, sets, _, n, _ in records[1:]:
        assert n == sum(r[3] == period and r[17] > 0 and str(r[2]) not in sets.split("-") for r in rows), component


def test_policy_probabilities_and_impossible_actions(spark):
    row = spark.createDataFrame([(3, 0.2)], "day int, g double")
    pi = lambda **k: row.select(policy.probability(F.col("day"), F.col("g"), **k)).first()[0]
    assert (pi(day=F.lit(3)), pi(day=F.lit(4)), pi(chance=0.5), pi()) == (1.0, 0.0, 0.5, 0.2)
    with pytest.raises(Exception, match="no behaviour probability"):
        row.select(policy.ratios(F.lit(1), F.lit(1.0), F.lit(0.0))["ratio"]).collect()


def test_rates_leave_the_fold_out(spark):
    df = spark.createDataFrame([(k % 3, "a", int(k < 5)) for k in range(9)] + [(0, "b", 1)], "fold long, c string, y int")
    got = {(r.fold, r.c): r.p for r in rates.crossfit_rates(df, ["c"], "y", 3).collect()}
    assert got[0, "a"] == pytest.approx(4 / 8) and got[2, "a"] == pytest.approx(5 / 8) and got[0, "b"] == 0.5 and got[1, "b"] == pytest.approx(2 / 3)


def test_nested_super_learner(spark):
    draw = np.random.default_rng(1)
    rows = [(int(k % 3), float(x := draw.normal()), 1.0, int(draw.uniform() < 1 / (1 + np.exp(-2 * x)))) for k in range(240)]
    df = spark.createDataFrame(rows, "fold long, x double, same double, y int")
    scored, weights = learners.super_learner(df, ["x", "same"], "y", ["logistic", "forest"])
    assert scored.count() == 240 and all(sum(w.values()) == pytest.approx(1) and why is None for w, why in weights.values())
    assert scored.agg(F.min("p"), F.max("p")).first()[0] >= 0 and scored.agg(F.corr("p", "y")).first()[0] > 0.3
    assert learners.super_learner(df.where("fold < 2"), ["x"], "y", ["logistic"])[1][0][1] == "fewer than two inner folds"
    assert {why for _, why in learners.super_learner(df.withColumn("y", F.lit(0)), ["x"], "y", ["logistic"])[1].values()} == {"one class"}


def test_fold_models_fall_back_and_return(spark, tmp_path):
    df = spark.createDataFrame([(0.0, None, k % 2, k / 9) for k in range(10)], "a double, b double, y int, c double")
    models = {0: learners.fit_fold_model(df, ["a", "b"], "y"), 1: learners.fit_fold_model(df, ["a", "c"], "y"), 2: learners.fit_fold_model(df.withColumn("y", F.lit(1)), ["c"], "y")}
    assert [m.fallback for m in models.values()] == ["no features", None, "one class"] and models[1].features == ["c"] and models[2].rate == pytest.approx(11 / 12)
    learners.save(models, f"{tmp_path}/models", spark)
    back = learners.load(f"{tmp_path}/models", spark)
    for k in models:
        assert [r.p for r in back[k].score(df, "p").collect()] == pytest.approx([r.p for r in models[k].score(df, "p").collect()])
    with pytest.raises(ValueError, match="empty"):
        learners.fit_fold_model(df.where("false"), ["c"], "y")
    calls = []
    build = lambda: calls.append(1) or df
    key = checks.content_fingerprint(df, ["y", "c"]).first().fingerprint
    assert key == checks.content_fingerprint(df.repartition(3).orderBy(F.desc("c")), ["y", "c"]).first().fingerprint != checks.content_fingerprint(df.limit(9), ["y", "c"]).first().fingerprint
    assert [learners.cached(spark, f"{tmp_path}/cache", key, build).count() for _ in range(2)] == [10, 10] and calls == [1]


def test_checks_refuse(spark):
    good = spark.createDataFrame([(1, "in", 1, 0.5), (2, "out", 0, 1.0)], "id long, state string, flag int, p double")
    bad = good.unionByName(spark.createDataFrame([(2, "gone", 2, float("nan")), (3, None, None, float("inf"))], good.schema))
    assert checks.require(good, {"p": checks.bad_probability("p"), "flag": checks.bad_flag("flag")}).count() == 2
    with pytest.raises(ValueError, match="'p': 2.*'flag': 2"):
        checks.require(bad, {"p": checks.bad_probability("p"), "flag": checks.bad_flag("flag")})
    assert checks.attached(good, good.select("id", F.col("p").alias("q")), ["id"]).count() == 2
    for left, right in ((good, bad.select("id")), (bad, good.select("id")), (good, good.where("id = 1").select("id"))):
        with pytest.raises(ValueError, match="more than once|no match"):
            checks.attached(left, right, ["id"])
    with pytest.raises(ValueError, match="true_risk"):
        checks.no_truth_columns(["x", "true_risk"])
    assert checks.state_features(good, ["p"]).columns == ["p"]
    with pytest.raises(ValueError, match="invalid"):
        checks.state_features(bad, ["p"])
    with pytest.raises(ValueError, match="missing"):
        checks.state_features(good, ["q"])
    assert checks.source_panel(good, ["flag"], confounders=["p", "flag"]).count() == 2
    for rows, options in ((bad, {}), (good, {"confounders": ["p"]}), (good.select("*", "p"), {})):
        with pytest.raises(ValueError, match="invalid|confounders|repeated"):
            checks.source_panel(rows, ["flag"], **options)


def test_columns(spark):
    df = spark.createDataFrame([(" Yes ", "a", 1.0), ("0", "b", None), ("x", None, 2.0)], "t string, c string, item_1 double")
    assert [r[0] for r in df.select(checks.parsed_boolean(F.col("t"))).collect()] == [True, False, None]
    assert [tuple(r) for r in df.select(*checks.one_hot("c", ["a", "z"])).collect()] == [(1, 0), (0, 0), (0, 0)]
    assert checks.named_like(df, "item_.*", "c") == ["c", "item_1"]
    assert checks.blanked(df, "item_.*").dtypes == df.dtypes and checks.blanked(df, "item_.*").where("item_1 IS NOT NULL").count() == 0


def test_fisher_p(spark):
    rows = [(g, a, b) for g, n in (("x", (8, 2, 1, 5)), ("y", (0, 0, 3, 4))) for (a, b), k in zip(((1, 1), (1, 0), (0, 1), (0, 0)), n) for _ in range(k)]
    got = {r.g: r for r in metrics.fisher_p(metrics.two_by_two(spark.createDataFrame(rows, "g string, a int, b int"), "g", "a", "b")).collect()}
    assert got["x"].fisher_p == pytest.approx(0.03496503, abs=1e-6) and got["y"].fisher_p == pytest.approx(1) and got["y"].chi_squared_p is None


def test_copies_and_folds_of_any_id(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "entity string, v int")
    drawn = spark.createDataFrame([(0, "a", 2), (0, "b", 1), (1, "b", 3)], "replicate long, entity string, times long")
    got = sorted((r.replicate, r.entity, r.copy, r.v) for r in bootstrap.copies(rows, drawn).collect())
    assert got == [(0, "a", 0, 1), (0, "a", 0, 2), (0, "a", 1, 1), (0, "a", 1, 2), (0, "b", 0, 3), (1, "b", 0, 3), (1, "b", 1, 3), (1, "b", 2, 3)]
    found = folds.grouped_folds(rows)
    assert found.count() == 2
    audit = {r.fold: r for r in folds.audit(rows.join(found.select("entity", "fold"), "entity"), "v").collect()}
    assert sum(r.held_rows for r in audit.values()) == 3 and all(r.shared_entities == 0 and r.train_rows + r.held_rows == 3 for r in audit.values())


def test_reports_and_collections_refuse(spark, tmp_path):
    df = spark.createDataFrame([(k, k % 3, 0.5) for k in range(6)], "entity long, policy_day long, x double")
    with pytest.raises(ValueError, match="more than 5"):
        sinks.transposed(df, "entity", ["x"], most=5)
    sinks.policy_panels(df, f"{tmp_path}/panels")
    assert tables.policy_collection(spark, f"{tmp_path}/panels", "entity long, x double, policy_day int", [0, 1, 2]).count() == 6
    with pytest.raises(ValueError, match="policy days"):
        tables.policy_collection(spark, f"{tmp_path}/panels", days=[0, 1])


def test_pieces_bound_what_a_task_holds(spark):
    d = nested.Design([("a", 1, None, 0.05), ("b", None, None, 0.05)], ["m"], 5, 3, 2, np.zeros(1))
    batch = pa.RecordBatch.from_arrays([pa.array(range(100_000))], names=["x"])
    parts = list(nested.pieces(batch, d))
    assert max(p.num_rows for p in parts) * len(d.policies) * len(d.measures) <= nested.PIECE and [x for p in parts for x in p.column(0).to_pylist()] == list(range(100_000))
    assert list(nested.pieces(batch.slice(0, 0), d)) == []


def test_refitted_risks_by_brute_force(spark):
    """Episodes alike in fold and steps are one kind, whatever their number and draws."""
    from chronopanel.plans import nuisance

    draw, steps = np.random.default_rng(9), [("in", 1, 0, 0, True), ("in", 2, 1, 0, True), ("out", 1, -1, 1, False), ("out", 1, -1, 1, True)]
    episodes = [(p, e, 10 * e, e % 5, tuple(sorted(draw.integers(0, 4, 1 + e % 3).tolist())), draw.integers(0, 3, 2).tolist()) for p in ("x", "y") for e in range(60)]
    rows = [(p, e, i, f, t, *steps[s]) for p, e, i, f, of, t in episodes for s in draw.permutation(of).tolist()]
    states = spark.createDataFrame(rows, "policy string, entity long, inserted long, fold long, times array<int>, policy_state string, c long, act0 int, rc long, in_window boolean")
    cells = sorted({("in", o, c, a) for o in ("outcome", "death") for c, a in ((1, 0), (2, 1))} | {("out", o, 1, -1) for o in ("outcome", "death")} | {("back", "reinsertion", 0, -1)})  # back at clock 1: no rows, so a half
    p = {(m, f, r): float(draw.uniform(0.1, 0.9)) for m in cells for f in range(5) for r in range(2)}
    models = spark.createDataFrame([(*m, f, r, x) for (m, f, r), x in p.items()], "m_state string, outcome string, clock long, act int, fold long, replicate long, p double")

    def kept(o, step, f, r):
        state, c, act, rc, window = step
        if (o == "reinsertion" and act == 0) or (o == "outcome" and not window):
            return 1.0
        return 1 - p.get((("back", o, rc, -1) if o == "reinsertion" else (state, o, c, act), f, r), 0.5)

    got = {(x.replicate, x.policy): x for x in nuisance.refitted_risks(states, models, 2).collect()}
    assert len(got) == 4
    for (r, policy_), x in got.items():
        mine = [(t[r], f, of) for q, _, _, f, of, t in episodes if q == policy_]
        assert x.n_copies == sum(n for n, _, _ in mine)
        for o in nuisance.HAZARD_OUTCOMES:
            want = sum(n * (1 - np.prod([kept(o, steps[s], f, r) for s in of])) for n, f, of in mine) / x.n_copies
            assert x[f"risk_{o}"] == pytest.approx(want, abs=1e-12)


def test_super_learner_fits_a_pair_once(spark, monkeypatch):
    fits, fit = [], learners.fit_fold_model
    monkeypatch.setattr(learners, "fit_fold_model", lambda rows, *x: fits.append(tuple(sorted(r[0] for r in rows.select("fold").distinct().collect()))) or fit(rows, *x))
    draw = np.random.default_rng(2)
    rows = spark.createDataFrame([(i % 3, float(x := draw.normal()), int(draw.uniform() < 1 / (1 + np.exp(-x)))) for i in range(90)], "fold int, x double, y int")
    scored, weights = learners.super_learner(rows, ["x"], "y", ["logistic"])
    assert sorted(fits) == [(0,), (0, 1), (0, 2), (1,), (1, 2), (2,)] and sorted(weights) == [0, 1, 2] and scored.count() == 90


def test_crossfit_reads_its_rows_seldom(spark, monkeypatch):
    draw = np.random.default_rng(4)
    rows = [(k % 3, float(x := draw.normal()), 50 + 9 * float(draw.normal()), 3.5, float(k % 3 == 0 or k % 2), int(draw.uniform() < 1 / (1 + np.exp(-x)))) for k in range(300)]
    features = ["x", "large", "same", "only_fold_0_is_constant"]
    df = spark.createDataFrame(rows, "fold long, x double, large double, same double, only_fold_0_is_constant double, y int").cache()
    holes = df.withColumn("large", F.when(F.col("x") > 1, None).when(F.col("x") < -1, float("nan")).otherwise(F.col("large")))
    p = lambda scored: [r.p for r in scored.orderBy("fold", "x").collect()]

    def one_by_one(train, target):
        return p(reduce(DataFrame.unionByName, [learners.fit_fold_model(train.where(f"fold != {k}"), features, "y").score(target.where(f"fold = {k}"), "p") for k in range(3)]))

    want = one_by_one(df, df)
    assert p(learners.crossfit(holes, features, "y")) == pytest.approx(one_by_one(holes, holes), abs=1e-6)
    assert p(learners.crossfit(df, features, "y", score_rows=holes)) == pytest.approx(one_by_one(df, holes), abs=1e-6)
    monkeypatch.setattr(learners, "learner", None)  # nothing is missing: no medians, no scaler
    assert p(learners.crossfit(df, features, "y")) == pytest.approx(want, abs=1e-6)
    assert p(learners.crossfit(df, features, "y", score_rows=df)) == pytest.approx(want, abs=1e-6)


def test_metrics_score_each_row_once(spark):
    scored = spark.sparkContext.accumulator(0)

    def each(batches):
        for b in batches:
            scored.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([("g", k % 2, k / 40) for k in range(40)], "group string, y int, p double").mapInArrow(each, "group string, y int, p double")
    assert metrics.binary_metrics(rows).first().brier == pytest.approx(np.mean([(k / 40 - k % 2) ** 2 for k in range(40)])) and scored.value == 40
