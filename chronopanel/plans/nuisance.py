"""Queries of cross-fitted nuisance models and of what is built on them, with their SQL.

Models here are rate tables by cell and ridges in closed form, so DuckDB can fit the same ones; ``operators.learners`` has the fitted families.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronopanel.checkpoints import cut, shared_dir
from chronopanel.functions.stats import rounded
from chronopanel.operators import bootstrap, checks, features, folds, metrics, nested, panel, policy, rates, trees
from chronopanel.plans import oracle
from chronopanel.plans.longitudinal import DAYS, EPISODE, WIDE, base, cleaned, decision_rows, scored_decisions
from chronopanel.sources import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Nested recursion

#: name, day of removal, chance of removal, clipping bound; neither day nor chance is current practice.
POLICIES = [*[(f"remove_on_day_{d}", d, None, 0.05) for d in DAYS], ("stochastic_half", None, 0.5, 0.05), (policy.CURRENT, None, None, 0.05)]
BOUNDS = [(f"remove_on_day_2_clipped_at_{e}", 2, None, e) for e in (0.01, 0.1, 0.2)]
MEASURES = ["outcome", "reinsertion", "death", "exit_alive", "exposure_days"]
TREND = ["interval_hours"]


def trajectory_rows(spark: SparkSession, folder: str, measures: list[str] = MEASURES, decided: DataFrame | None = None) -> DataFrame:
    """Decision rows (``decided``, if they are there already) up to the last period that every pair of folds leaves support for, with what ``nested`` reads; only the outcome has a risk set."""
    rows = (decision_rows(spark, folder) if decided is None else decided).withColumn("day", F.col("episode_day")).withColumn("cell", F.col("g_day"))
    rows = rows.withColumns({f"risk_{m}": F.col("at_risk_outcome").cast("double") if m == "outcome" else F.lit(1.0) for m in measures})
    return rows.where(F.col("decision_period") <= nested.supported(rows, measures))


def nested_of(spark: SparkSession, folder: str, policies: list[tuple], measures: list[str] = MEASURES) -> DataFrame:
    return nested.nested_scores(trajectory_rows(spark, folder, measures), EPISODE, TREND, policies, measures)


MOMENTS = ", ".join(f"sum(w{f}) AS {n}" for n, f in (("n", ""), ("y", " * y"), ("x", " * x"), ("a", " * a"), ("xx", " * x * x"), ("xa", " * x * a"), ("aa", " * a * a"), ("xy", " * x * y"), ("ay", " * a * y")))


def _ridge(source: str, keys: str) -> str:
    """SQL: keys, b0, bx, ba from power sums, as in ``nested.solved`` with a penalty of 1."""
    return (
        f"SELECT {keys}, my - coalesce(bx, 0) * mx - coalesce(ba, 0) * ma AS b0, coalesce(bx, 0) AS bx, coalesce(ba, 0) AS ba FROM (SELECT *, "
        "((n + 1) * n * cx - n * r * n * ca) / ((n + 1) * (n + 1) - n * r * n * r) / nullif(sx, 0) AS bx, ((n + 1) * n * ca - n * r * n * cx) / ((n + 1) * (n + 1) - n * r * n * r) / nullif(sa, 0) AS ba FROM (SELECT *, "
        "coalesce((xy / n - mx * my) / nullif(sx, 0), 0) AS cx, coalesce((ay / n - ma * my) / nullif(sa, 0), 0) AS ca, coalesce((xa / n - mx * ma) / nullif(sx * sa, 0), 0) AS r FROM (SELECT *, "
        "CASE WHEN xx / n - mx * mx > 1e-12 THEN sqrt(xx / n - mx * mx) ELSE 0 END AS sx, CASE WHEN aa / n - ma * ma > 1e-12 THEN sqrt(aa / n - ma * ma) ELSE 0 END AS sa FROM (SELECT *, y / n AS my, x / n AS mx, a / n AS ma "
        f"FROM ({source})))))"
    )


STEP = "(1 - pi) * risk * (b0 + bx * x) + pi * risk * (b0 + bx * x + ba)"
SEEN = "risk * (b0 + bx * x + ba * a)"


def _folded(name: str, source: str, keys: str) -> str:
    """SQL: the linear recursion over the decisions of each key, last one first, from columns c (own part) and ratio."""
    on = " AND ".join(f"b.{k} = f.{k}" for k in keys.split(", "))
    return f"{name}_b AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY t DESC) AS back FROM {source}), {name} AS (SELECT {keys}, fold, t, back, c AS score FROM {name}_b WHERE back = 1 UNION ALL SELECT {', '.join('b.' + k for k in keys.split(', '))}, b.fold, b.t, b.back, b.c + b.ratio * f.score FROM {name} f JOIN {name}_b b ON {on} AND b.back = f.back + 1)"


SCORES = oracle.SCORES[: oracle.SCORES.index("sc0 AS")].rstrip().rstrip(",").rsplit(",\nqrate_own", 1)[0]
ONCE = "wt AS (SELECT DISTINCT 0::BIGINT AS rep, entity, 1::DOUBLE AS times FROM decf)"
_PI = "CASE WHEN d IS NOT NULL THEN CAST(day >= d AS DOUBLE) WHEN chance IS NOT NULL THEN chance ELSE g END"


def _with_g(rows: str, more: str, sets: str, j: str, k: str) -> str:
    """SQL: rows with the behaviour model of the fold set (j, k), the policy's chance and the ratio."""
    return (
        f"SELECT *, CASE WHEN a = 1 THEN pi / least(greatest(g, eps), 1 - eps) ELSE (1 - pi) / (1 - least(greatest(g, eps), 1 - eps)) END AS ratio "
        f"FROM (SELECT *, {_PI} AS pi FROM (SELECT nr.*{more}, gs.g FROM {rows} nr {sets} JOIN gs ON gs.rep = nr.rep AND gs.cell = nr.cell AND gs.j = {j} AND gs.k = {k}))"
    )


def nested_sql(named: list[tuple], measures: list[str] = MEASURES, weights: str = ONCE) -> str:
    """SQL of the nested recursion: table done (scores) and fr (what they are made of)."""
    values = ", ".join(f"('{n}', {d or 'NULL'}, {c or 'NULL'}, {e})" for n, d, c, e in named)
    names = ", ".join(f"('{m}')" for m in measures)
    reward = "CASE m.measure " + " ".join(f"WHEN '{m}' THEN reward_{m}::DOUBLE" for m in measures) + " END"
    keys = "rep, policy, measure, entity, inserted"
    same = lambda x, y, names: " AND ".join(f"{x}.{n} = {y}.{n}" for n in names.split(", "))
    return (
        SCORES
        + f""",
{weights},
hz AS (SELECT coalesce(min(CASE WHEN nf <= 2 THEN decision_period END) - 1, max(decision_period)) AS h FROM (SELECT decision_period, count(DISTINCT CASE WHEN at_risk_outcome = 1 THEN fold END) AS nf FROM decf GROUP BY 1)),
dh AS (SELECT decf.*, rep, times, least(episode_day, 6) AS cell FROM decf JOIN wt USING (entity), hz WHERE decision_period <= h),
fsets AS (SELECT a.i AS j, b.i AS k FROM (SELECT unnest(range(0, 5)) AS i) a JOIN (SELECT unnest(range(0, 5)) AS i) b ON a.i <= b.i),
gs AS (SELECT j, k, rep, cell, (sum(CASE WHEN fold <> j AND fold <> k THEN times * removed_in ELSE 0 END) + 1) / (sum(CASE WHEN fold <> j AND fold <> k THEN times ELSE 0 END) + 2) AS g FROM dh, fsets GROUP BY ALL),
nr AS (SELECT rep, times, p.policy, p.d, p.chance::DOUBLE AS chance, p.eps::DOUBLE AS eps, m.measure, entity, inserted, fold, decision_period AS t, interval_hours AS x, removed_in::DOUBLE AS a, cell, episode_day AS day,
  {reward} AS reward, CASE m.measure WHEN 'outcome' THEN at_risk_outcome::DOUBLE ELSE 1 END AS risk FROM dh, (VALUES {values}) p(policy, d, chance, eps), (VALUES {names}) m(measure)),
tr AS ({_with_g('nr', ', s.j, s.k', 'JOIN fsets s ON s.j < s.k AND nr.fold <> s.j AND nr.fold <> s.k', 's.j', 's.k')}),
rec AS (SELECT 0::BIGINT AS rep, NULL::VARCHAR AS policy, NULL::VARCHAR AS measure, 0::BIGINT AS j, 0::BIGINT AS k, 0::BIGINT AS entity, 0::BIGINT AS inserted, (SELECT max(t) + 1 FROM nr) AS t, 0::DOUBLE AS score, NULL::DOUBLE AS b0, NULL::DOUBLE AS bx, NULL::DOUBLE AS ba
  UNION ALL SELECT {keys}, j, k, t, score, b0, bx, ba FROM (SELECT rep, policy, measure, j, k, entity, inserted, t, coalesce({STEP.replace(' x)', ' x0)').replace(' x +', ' x0 +')}, 0) + ratio * (reward + nxt - coalesce({SEEN.replace(' x +', ' x0 +').replace('* a)', '* a0)')}, 0)) AS score, b0, bx, ba FROM (""".replace(f"SELECT {keys}, j, k, t, score", "SELECT rep, policy, measure, j, k, entity, inserted, t, score")
        + _ridge(
            f"SELECT rep, policy, measure, j, k, entity, inserted, t, pi, ratio, reward, risk, nxt, x AS x0, a AS a0, {MOMENTS.replace(') AS', ') OVER win AS')} FROM (SELECT tr.*, coalesce(prev.score, 0) AS nxt, tr.reward + coalesce(prev.score, 0) AS y, CASE WHEN tr.risk > 0 THEN tr.times END AS w FROM tr JOIN (SELECT max(t) - 1 AS st FROM rec) now ON tr.t = now.st "
            f"LEFT JOIN rec prev ON {same('prev', 'tr', keys + ', j, k')}) WINDOW win AS (PARTITION BY rep, policy, measure, j, k)",
            "rep, policy, measure, j, k, entity, inserted, t, pi, ratio, reward, risk, nxt, x0, a0",
        )
        + f"""))),
aux AS (SELECT DISTINCT rep, policy, measure, j, k, t, b0, bx, ba FROM rec WHERE b0 IS NOT NULL),
hr AS (SELECT q.*, coalesce({STEP}, 0) + ratio * (reward - coalesce({SEEN}, 0)) AS c FROM (SELECT z.*, b0, bx, ba FROM ({_with_g('nr', ', o.i AS outer_fold', 'JOIN (SELECT unnest(range(0, 5)) AS i) o ON o.i <> nr.fold', 'least(nr.fold, o.i)', 'greatest(nr.fold, o.i)')}) z
  LEFT JOIN aux ON {same('aux', 'z', 'rep, policy, measure, t')} AND aux.j = least(z.fold, outer_fold) AND aux.k = greatest(z.fold, outer_fold)) q),
{_folded('held', 'hr', keys + ', outer_fold')},
ot AS (SELECT hr.rep, hr.policy, hr.measure, hr.outer_fold, hr.t, hr.x, hr.a, hr.times AS w, hr.reward + coalesce(h.score, 0) AS y FROM hr LEFT JOIN held h ON {same('h', 'hr', keys + ', outer_fold')} AND h.t = hr.t + 1 WHERE hr.risk > 0),
om AS ({_ridge(f'SELECT rep, policy, measure, outer_fold, t, {MOMENTS} FROM ot GROUP BY ALL', 'rep, policy, measure, outer_fold, t')}),
fr AS (SELECT q.*, coalesce({STEP}, 0) + ratio * (reward - coalesce({SEEN}, 0)) AS c FROM (SELECT z.*, b0, bx, ba FROM ({_with_g('nr', '', '', 'nr.fold', 'nr.fold')}) z LEFT JOIN om ON {same('om', 'z', 'rep, policy, measure, t')} AND om.outer_fold = z.fold) q),
{_folded('done', 'fr', keys)}"""
    )


NESTED = nested_sql(POLICIES)


@query(f"WITH RECURSIVE {NESTED} SELECT policy, measure, count(*) AS n_episodes, round(avg(score), 6) AS value, round(stddev_samp(score), 6) AS sd FROM done WHERE t = 1 GROUP BY policy, measure")
def nested_policy_values(spark, folder):
    """Values of fixed-day, stochastic and current policies for all five measures by the nested cross-fitted recursion."""
    scores = nested_of(spark, folder, POLICIES).where("decision_period = 1")
    return rounded(scores.groupBy("policy", "measure").agg(F.count("*").alias("n_episodes"), F.avg("score").alias("value"), F.stddev_samp("score").alias("sd")))


@query(f"WITH RECURSIVE {nested_sql(POLICIES[:5], ['outcome'])} SELECT policy, count(*) AS n_episodes, round(avg(score), 6) AS value, round(stddev_samp(score), 6) AS sd FROM done WHERE t = 1 GROUP BY policy")
def dml_policy_values(spark, folder):
    """Values of the fixed-day policies for the outcome, from nested cross-fitted continuation fits."""
    scores = nested_of(spark, folder, POLICIES[:5], ["outcome"]).where("decision_period = 1")
    return rounded(scores.groupBy("policy").agg(F.count("*").alias("n_episodes"), F.avg("score").alias("value"), F.stddev_samp("score").alias("sd")))


TWO = ["outcome", "exposure_days"]


@query(f"WITH RECURSIVE {nested_sql(BOUNDS, TWO)} SELECT policy, measure, count(*) AS n_episodes, round(avg(score), 6) AS value FROM done WHERE t = 1 GROUP BY policy, measure")
def clipping_refits(spark, folder):
    """Values under several clipping bounds, each with continuations of its own, as their targets depend on the ratios."""
    scores = nested_of(spark, folder, BOUNDS, TWO).where("decision_period = 1")
    return rounded(scores.groupBy("policy", "measure").agg(F.count("*").alias("n_episodes"), F.avg("score").alias("value")))


COIN = [p for p in POLICIES if p[0] == "stochastic_half"]


@query(f"WITH RECURSIVE {nested_sql(COIN)} SELECT policy, entity, inserted, {', '.join(f'round(max(CASE WHEN measure = {m!r} THEN score END), 5) AS {m}' for m in MEASURES)} FROM done WHERE t = 1 GROUP BY policy, entity, inserted")
def episode_scores(spark, folder):
    """The scores of each episode under one policy, a column for each measure."""
    scores = nested_of(spark, folder, COIN).where("decision_period = 1")
    return rounded(scores.groupBy("policy", *EPISODE).pivot("measure", MEASURES).agg(F.first("score")), 5)


@query(
    f"WITH RECURSIVE {nested_sql(POLICIES[1:2] + POLICIES[-1:], TWO)} SELECT policy, measure, entity, inserted, t AS decision_period, fold, round(risk * (b0 + bx * x), 5) AS q_keep, round(risk * (b0 + bx * x + ba), 5) AS q_remove, round(pi, 6) AS pi, round(g, 6) AS g, round(ratio, 6) AS ratio, round(coalesce(later.score, 0), 5) AS next_score, round(done.score, 5) AS score "
    "FROM fr JOIN done USING (rep, policy, measure, entity, inserted, t, fold) LEFT JOIN (SELECT policy, measure, entity, inserted, t - 1 AS t, score FROM done) later USING (policy, measure, entity, inserted, t)"
)
def nested_decisions(spark, folder):
    """Every decision under two policies with its held-out continuation under both actions, its ratio and its scores."""
    scores = nested_of(spark, folder, POLICIES[1:2] + POLICIES[-1:], TWO)
    return scores.select("policy", "measure", *EPISODE, "decision_period", "fold", *[F.round(c, 6 if c in ("pi", "g", "ratio") else 5).alias(c) for c in nested.DETAIL])


REFIT_POLICIES, REFIT_DRAWS, REFIT_SEED = POLICIES[1:2] + POLICIES[-1:], 10, 41


def cached_fit(spark: SparkSession, folder: str) -> tuple[DataFrame, nested.Fit]:
    """Episodes and the models of two policies, kept by contents and settings in the shared folder: a second run over the same rows fits nothing."""
    rows = cut(trajectory_rows(spark, folder, TWO))
    episodes, d = nested.prepared(rows, EPISODE, TREND, REFIT_POLICIES, TWO, 5, 1.0, None, 1)
    return episodes, nested.cached_fit(rows, episodes, d, TREND, f"{shared_dir(spark)}/nested-fits")


@query(f"WITH RECURSIVE {nested_sql(REFIT_POLICIES, TWO)} SELECT policy, measure, count(*) AS n_episodes, round(avg(score), 6) AS value FROM done WHERE t = 1 GROUP BY policy, measure")
def cached_policy_values(spark, folder):
    """Values by models that were saved and read back."""
    episodes, found = cached_fit(spark, folder)
    scores = nested.scores(episodes, EPISODE, found).where("decision_period = 1")
    return rounded(scores.groupBy("policy", "measure").agg(F.count("*").alias("n_episodes"), F.avg("score").alias("value")))


@query(
    f"WITH RECURSIVE {nested_sql(REFIT_POLICIES, TWO)}, seen AS (SELECT t, fold, count(*) AS n FROM nr WHERE policy = 'current_practice' AND measure = 'outcome' AND risk > 0 GROUP BY ALL), st AS (SELECT unnest(range(1, (SELECT max(t) FROM nr) + 1)) AS period) "
    "SELECT CASE WHEN j = k THEN 'continuation' ELSE 'auxiliary_continuation' END AS component, CAST(period AS INT) AS period, CASE WHEN j = k THEN j::VARCHAR ELSE j || '-' || k END AS left_out, coalesce(sum(n) FILTER (WHERE fold <> j AND fold <> k), 0)::BIGINT AS n_at_risk, true AS timed FROM fsets CROSS JOIN st LEFT JOIN seen ON t = period GROUP BY j, k, period"
)
def fit_records(spark, folder):
    """What was fitted: component, period, folds left out, training rows at risk of the outcome, and whether its time was taken."""
    _, found = cached_fit(spark, folder)
    rows = [(c, t, sets, int(n), seconds >= 0) for c, t, sets, _, n, seconds in found.records if c != "behaviour"]
    return spark.createDataFrame(rows, "component string, period int, left_out string, n_at_risk bigint, timed boolean")


@query()
def fit_seconds(spark, folder):
    """Fits and seconds by component, from the records of the fits."""
    _, found = cached_fit(spark, folder)
    rows = spark.createDataFrame([(r[0], r[-1]) for r in found.records], "component string, seconds double")
    return rows.groupBy("component").agg(F.count("*").alias("n_fits"), F.sum("seconds").alias("seconds"))


def _drawn_sql(n: int, seed: int) -> str:
    return (
        "wn AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS number, count(*) OVER () AS n_all FROM (SELECT DISTINCT entity FROM decf)), "
        f"wt AS (SELECT rep, wn.entity, times::DOUBLE AS times FROM (SELECT rep, CAST(floor({oracle.uniform(seed, 'rep', 'draw')} * n_all) AS BIGINT) AS number, count(*) AS times FROM (SELECT unnest(range(0, {n})) AS rep), (SELECT number AS draw, n_all FROM wn) GROUP BY 1, 2) JOIN wn USING (number))"
    )


@query(f"WITH RECURSIVE {nested_sql(REFIT_POLICIES, TWO, _drawn_sql(REFIT_DRAWS, REFIT_SEED))} SELECT rep AS replicate, policy, measure, sum(times)::BIGINT AS n, round(sum(times * score) / sum(times), 6) AS value FROM done JOIN wt USING (rep, entity) WHERE t = 1 GROUP BY rep, policy, measure")
def nested_bootstrap(spark, folder):
    """Values by replicate with every behaviour and continuation model fitted anew on the entities drawn. A period that a replicate leaves without support has continuation 0."""
    decided = decision_rows(spark, folder)
    rows = trajectory_rows(spark, folder, TWO, decided)
    numbers = cut(bootstrap.entity_numbers(decided))  # counted and joined
    drawn = bootstrap.draws(max(1, numbers.count()), REFIT_DRAWS, REFIT_SEED, spark).join(numbers, "number")
    return rounded(nested.nested_bootstrap(rows, EPISODE, TREND, REFIT_POLICIES, TWO, bootstrap.draw_arrays(drawn, REFIT_DRAWS), REFIT_DRAWS, strict=False))


# Outcome models and the g-formula on them

#: state, outcome, label, risk set, cell: the clocks that the models see.
IN_OUTCOMES = ("outcome", "death", "exit_alive", "no_event")
OUT_OUTCOMES = ("reinsertion", "outcome", "death", "exit_alive", "no_event")


def targets(rows: DataFrame) -> DataFrame:
    """Panel rows with folds, the label "no event" and the models' clocks."""
    fold = folds.grouped_folds(rows).select("entity", "fold")
    none = (F.col("reinsertion_in") + F.col("outcome_in") + F.col("death_in") + F.col("exit_alive_in") == 0).cast("int")
    return rows.drop("outcome").join(fold, "entity").withColumn("no_event_in", none).withColumn("in_clock", F.least("episode_day", F.lit(6))).withColumn("out_clock", F.least(F.greatest("periods_in_state", F.lit(1)), F.lit(5))).withColumn("r_clock", F.least("reinsertion_periods", F.lit(5)))


CELL = ["m_state", "outcome", "clock", "act"]


def training_rows(rows: DataFrame, *more: str) -> DataFrame:
    """fold, ``more``, and the model, clock, action and label y of every model whose risk set a row is in."""
    one = F.struct
    at = lambda state, names: [one(F.lit(state).alias("m_state"), F.lit(n).alias("outcome"), F.col(f"{n}_in").alias("y"), F.col("in_clock" if state == "in" else "out_clock").alias("clock"), (F.col("removed_in") if state == "in" else F.lit(-1)).alias("act"), ((F.col("state") == state) & ((F.col("at_risk_outcome") == 1) | F.lit(n != "outcome"))).alias("used")) for n in names]
    back = one(F.lit("back").alias("m_state"), F.lit("reinsertion").alias("outcome"), F.col("reinsertion_in").alias("y"), F.col("r_clock").alias("clock"), F.lit(-1).alias("act"), (F.col("at_risk_reinsertion") == 1).alias("used"))
    models = [*at("in", IN_OUTCOMES), *at("out", [n for n in OUT_OUTCOMES if n != "reinsertion"]), back]
    return rows.select("fold", *more, F.explode(F.array(*models)).alias("m")).select("fold", *more, "m.*").where("used")


def outcome_models(rows: DataFrame) -> DataFrame:
    """state, outcome, clock, action, fold, p: every model as a rate table, fitted on its risk set of the other folds."""
    return rates.crossfit_rates(training_rows(rows), CELL, "y")


def refitted_models(rows: DataFrame, replicates: int) -> DataFrame:
    """``outcome_models`` with ``replicate``, from the entities drawn. ``rows`` have ``times``, an array by replicate: counts of cells are weighted, rows aren't copied."""
    counts = training_rows(rows, "times").groupBy("fold", *CELL, "y").agg(F.array(*[F.sum(F.col("times")[r]) for r in range(replicates)]).alias("times"))
    drawn = counts.select("fold", *CELL, "y", F.posexplode("times").alias("replicate", "times")).where("times > 0").withColumn("replicate", F.col("replicate").cast("bigint"))
    return rates.crossfit_rates(drawn, [*CELL, "replicate"], "y", weight="times")


def _models_sql(rows: str, weight: str = "1.0", more: str = "") -> str:
    """SQL for ``outcome_models``: table mod."""
    parts = [(s, n) for s, names in (("in", IN_OUTCOMES), ("out", [n for n in OUT_OUTCOMES if n != "reinsertion"])) for n in names]
    one = [f"SELECT fold{more}, {weight} AS w, '{s}' AS m_state, '{n}' AS outcome, {n}_in AS y, {'in_clock' if s == 'in' else 'out_clock'} AS clock, {'removed_in' if s == 'in' else '-1'} AS act FROM {rows} WHERE state = '{s}'{' AND at_risk_outcome = 1' if n == 'outcome' else ''}" for s, n in parts]
    one.append(f"SELECT fold{more}, {weight}, 'back', 'reinsertion', reinsertion_in, r_clock, -1 FROM {rows} WHERE at_risk_reinsertion = 1")
    keys = "m_state, outcome, clock, act" + more
    on = " AND ".join(f"o.{k} = t.{k}" for k in keys.split(", "))
    return (
        f"mlong AS ({' UNION ALL '.join(one)}), mown AS (SELECT fold, {keys}, sum(w) AS n, sum(w * y) AS e FROM mlong GROUP BY ALL), "
        f"mod AS (SELECT f.fold, {', '.join('t.' + k for k in keys.split(', '))}, (t.e - coalesce(o.e, 0) + 1) / (t.n - coalesce(o.n, 0) + 2) AS p FROM (SELECT {keys}, sum(n) AS n, sum(e) AS e FROM mown GROUP BY ALL) t CROSS JOIN (SELECT unnest(range(0, 5)) AS fold) f LEFT JOIN mown o ON o.fold = f.fold AND {on})"
    )


TARGETS = (
    oracle.PANEL
    + ",\n"
    + oracle.FOLD.format(rows="panel")
    + ",\ntg AS (SELECT panel.* EXCLUDE (outcome), fold, CAST(reinsertion_in + outcome_in + death_in + exit_alive_in = 0 AS INT) AS no_event_in, least(episode_day, 6) AS in_clock, least(greatest(periods_in_state, 1), 5) AS out_clock, least(reinsertion_periods, 5) AS r_clock FROM panel JOIN fold USING (entity))"
)


def looked_up(rows: DataFrame, models: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (m_state, outcome, clock, act, fold and ``keys``) with ``p``; a half for a cell that no training row had."""
    on = ["m_state", "outcome", "clock", "act", "fold", *keys]
    return rows.join(models, on, "left").withColumn("p", F.coalesce("p", F.lit(0.5)))


@query(
    f"WITH {TARGETS}, {_models_sql('tg')}, ask AS (SELECT tg.*, 'in' AS m_state, o.outcome, in_clock AS clock, a.act, CASE a.act WHEN 0 THEN 'keep' ELSE 'remove' END AS given FROM tg, (SELECT unnest({list(IN_OUTCOMES)}) AS outcome) o, (SELECT unnest([0, 1]) AS act) a WHERE state = 'in' "
    f"UNION ALL SELECT tg.*, CASE o.outcome WHEN 'reinsertion' THEN 'back' ELSE 'out' END, o.outcome, CASE o.outcome WHEN 'reinsertion' THEN r_clock ELSE out_clock END, -1, 'out' FROM tg, (SELECT unnest({list(OUT_OUTCOMES)}) AS outcome) o WHERE state = 'out') "
    "SELECT entity, inserted, episode_index, ask.outcome, given, round(CASE WHEN (ask.outcome = 'outcome' AND at_risk_outcome = 0) OR (ask.outcome = 'reinsertion' AND at_risk_reinsertion = 0) THEN 0 ELSE coalesce(p, 0.5) END, 6) AS p "
    "FROM ask LEFT JOIN mod ON mod.m_state = ask.m_state AND mod.outcome = ask.outcome AND mod.clock = ask.clock AND mod.act = ask.act AND mod.fold = ask.fold"
)
def outcome_scores(spark, folder):
    """Held-out probabilities of every outcome: IN rows under both actions, OUT rows once; structural zeros outside the risk sets."""
    rows = targets(base(spark, folder))
    ask = lambda state, outcome, clock, act, given: F.struct(F.lit(state).alias("m_state"), F.lit(outcome).alias("outcome"), F.col(clock).alias("clock"), F.lit(act).alias("act"), F.lit(given).alias("given"))
    inside = F.array(*[ask("in", n, "in_clock", a, g) for n in IN_OUTCOMES for a, g in ((0, "keep"), (1, "remove"))])
    outside = F.array(*[ask("back" if n == "reinsertion" else "out", n, "r_clock" if n == "reinsertion" else "out_clock", -1, "out") for n in OUT_OUTCOMES])
    asked = rows.withColumn("a", F.explode(F.when(F.col("state") == "in", inside).otherwise(outside))).select("*", "a.*")
    zero = (F.col("outcome") == "outcome") & (F.col("at_risk_outcome") == 0) | (F.col("outcome") == "reinsertion") & (F.col("at_risk_reinsertion") == 0)
    return rounded(looked_up(asked, outcome_models(rows)).withColumn("p", F.when(zero, 0.0).otherwise(F.col("p"))).select(*EPISODE, "episode_index", "outcome", "given", "p"))


HAZARD_OUTCOMES = ("outcome", "death", "reinsertion")


STATE = ["policy_state", "c", "act0", "rc", "in_window"]


def policy_states(rows: DataFrame) -> DataFrame:
    """Panel rows under each fixed-day policy and as observed, with their state and clocks."""
    under = policy.with_policies(rows, DAYS)
    clock = F.when(F.col("policy_state") == "in", F.least("policy_periods_in", F.lit(6))).otherwise(F.least(F.greatest("policy_periods_out", F.lit(1)), F.lit(5)))
    act = F.when(F.col("policy_state") == "out", -1).when(F.col("policy_action") == "remove", 1).otherwise(0)
    fixed = under.select("policy", *EPISODE, "episode_index", "fold", "interval_hours", "policy_state", clock.alias("c"), act.alias("act0"), F.least("policy_reinsertion_periods", F.lit(5)).alias("rc"), (F.coalesce("policy_periods_out", F.lit(0)) <= 2).alias("in_window"))
    seen = rows.select(F.lit(policy.CURRENT).alias("policy"), *EPISODE, "episode_index", "fold", "interval_hours", F.col("state").alias("policy_state"), F.when(F.col("state") == "in", F.col("in_clock")).otherwise(F.col("out_clock")).alias("c"), F.when(F.col("state") == "in", F.col("removed_in")).otherwise(-1).alias("act0"), F.col("r_clock").alias("rc"), (F.col("period_start") < F.col("removed") + panel.OUTCOME_WINDOW).alias("in_window"))
    return fixed.unionByName(seen)


def asked(states: DataFrame) -> DataFrame:
    """``states`` with the model, clock and action that each hazard asks for.

    No factual risk flag enters: a hazard is that of the policy's own state. Keeping has no reinsertion hazard; removing asks the reinsertion model
    at clock 0. The outcome's hazard is 0 from the third day out on, and for current practice beyond the window after removal.
    """
    both = states.withColumn("outcome", F.explode(F.array(*map(F.lit, HAZARD_OUTCOMES))))
    back = F.col("outcome") == "reinsertion"
    zero = F.when(back, F.col("act0") == 0).when(F.col("outcome") == "outcome", ~F.col("in_window")).otherwise(False)
    return both.select("*", F.when(back, "back").otherwise(F.col("policy_state")).alias("m_state"), F.when(back, F.col("rc")).otherwise(F.col("c")).alias("clock"), F.when(back, -1).otherwise(F.col("act0")).alias("act"), zero.alias("zero"))


def policy_hazards_of(rows: DataFrame, models: DataFrame) -> DataFrame:
    return looked_up(asked(policy_states(rows)), models)


ASKS = (
    oracle.POLICY[len(oracle.PANEL) :].lstrip(",\n").replace("FROM panel, (SELECT unnest([1, 2, 3, 4, 5])", "FROM tg, (SELECT unnest([1, 2, 3, 4, 5])")
    + """,
both0 AS (SELECT policy, entity, inserted, episode_index, fold, interval_hours, policy_state, CASE WHEN policy_state = 'in' THEN least(policy_periods_in, 6) ELSE least(greatest(policy_periods_out, 1), 5) END AS c,
  CASE WHEN policy_state = 'out' THEN -1 WHEN policy_action = 'remove' THEN 1 ELSE 0 END AS act0, least(policy_reinsertion_periods, 5) AS rc, coalesce(policy_periods_out, 0) <= 2 AS in_window FROM pol
  UNION ALL SELECT 'current_practice', entity, inserted, episode_index, fold, interval_hours, state, CASE WHEN state = 'in' THEN in_clock ELSE out_clock END, CASE WHEN state = 'in' THEN removed_in ELSE -1 END, r_clock, period_start < removed + 172800000000 FROM tg),
asks AS (SELECT b.*, o.outcome, CASE o.outcome WHEN 'reinsertion' THEN 'back' ELSE policy_state END AS m_state, CASE o.outcome WHEN 'reinsertion' THEN rc ELSE c END AS clock, CASE o.outcome WHEN 'reinsertion' THEN -1 ELSE act0 END AS act,
  CASE o.outcome WHEN 'reinsertion' THEN act0 = 0 WHEN 'outcome' THEN NOT in_window ELSE false END AS zero FROM both0 b, (SELECT unnest(['outcome', 'death', 'reinsertion']) AS outcome) o)"""
)
HAZ = f"WITH {TARGETS}, {_models_sql('tg')}, {ASKS}, hz AS (SELECT asks.*, CASE WHEN zero THEN 0 ELSE coalesce(p, 0.5) END AS hazard FROM asks LEFT JOIN mod USING (m_state, outcome, clock, act, fold))"


def hazard(df: DataFrame) -> DataFrame:
    return df.withColumn("hazard", F.when(F.col("zero"), 0.0).otherwise(F.col("p")))


@query(f"{HAZ} SELECT policy, entity, inserted, episode_index, outcome, round(hazard, 6) AS hazard FROM hz")
def policy_hazards(spark, folder):
    """Each outcome's hazard in each period under each policy, from the held-out models of the entity's fold."""
    rows = targets(base(spark, folder))
    return rounded(hazard(policy_hazards_of(rows, outcome_models(rows))).select("policy", *EPISODE, "episode_index", "outcome", "hazard"))


def crossfit_risks(hazards: DataFrame) -> DataFrame:
    """policy, episode: 1 - prod(1 - hazard) for each outcome."""
    risk = lambda o: (1 - F.product(F.when(F.col("outcome") == o, 1 - F.col("hazard")))).alias(f"risk_{o}")
    return hazards.groupBy("policy", *EPISODE).agg(*[risk(o) for o in HAZARD_OUTCOMES])


_RISKS = ", ".join(f"1 - product(CASE WHEN outcome = '{o}' THEN 1 - hazard END) AS risk_{o}" for o in HAZARD_OUTCOMES)
_MEANS = ", ".join(f"round(avg(risk_{o}), 6) AS risk_{o}" for o in HAZARD_OUTCOMES)


@query(f"{HAZ} SELECT policy, count(*) AS n_episodes, {_MEANS} FROM (SELECT policy, entity, inserted, {_RISKS} FROM hz GROUP BY ALL) GROUP BY policy")
def crossfit_gformula(spark, folder):
    """Mean episode risks of every policy by the plug-in g-formula on cross-fitted outcome models."""
    rows = targets(base(spark, folder))
    risks = crossfit_risks(hazard(policy_hazards_of(rows, outcome_models(rows))))
    return rounded(risks.groupBy("policy").agg(F.count("*").alias("n_episodes"), *[F.avg(f"risk_{o}").alias(f"risk_{o}") for o in HAZARD_OUTCOMES]))


# Bootstrap with refitted models

REFITS, SEED = 5, 77


def drawn_rows(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows, drawn): panel rows with folds, and replicate, entity, times."""
    rows = cut(targets(base(spark, folder)))  # read by the draws, the models and each policy
    numbers = cut(bootstrap.entity_numbers(rows))
    drawn = bootstrap.draws(max(1, numbers.count()), REFITS, SEED, spark)
    return rows, drawn.join(numbers, "number").select("replicate", "entity", "times")


DRAWN = (
    "nums AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS number, count(*) OVER () AS n_all FROM (SELECT DISTINCT entity FROM tg)), "
    f"drawn AS (SELECT replicate, nums.entity, times FROM (SELECT replicate, CAST(floor({oracle.uniform(SEED, 'replicate', 'draw')} * n_all) AS BIGINT) AS number, count(*) AS times FROM (SELECT unnest(range(0, {REFITS})) AS replicate), (SELECT number AS draw, n_all FROM nums) GROUP BY 1, 2) JOIN nums USING (number)), "
    "dr AS (SELECT tg.*, replicate, times FROM tg JOIN drawn USING (entity))"
)


@query(
    f"WITH {TARGETS}, {DRAWN}, {_models_sql('dr', 'times', ', replicate')}, {ASKS}, hz AS (SELECT asks.*, d.replicate, d.times, CASE WHEN zero THEN 0 ELSE coalesce(p, 0.5) END AS hazard FROM asks JOIN drawn d USING (entity) LEFT JOIN mod USING (m_state, outcome, clock, act, fold, replicate)) "
    + "SELECT replicate, policy, "
    + ", ".join(f"round(sum(times * risk_{o}) / sum(times), 6) AS risk_{o}" for o in HAZARD_OUTCOMES)
    + f", sum(times)::BIGINT AS n_copies FROM (SELECT policy, replicate, times, entity, inserted, {_RISKS} FROM hz GROUP BY ALL) GROUP BY replicate, policy"
)
def bootstrap_refit(spark, folder):
    """Risks by replicate with every model fitted anew on the entities drawn, each as often as drawn. Copies keep their entity's fold."""
    rows, drawn = drawn_rows(spark, folder)
    drawn = bootstrap.draw_arrays(drawn, REFITS)
    return rounded(refitted_risks(policy_states(rows).join(drawn, "entity"), refitted_models(rows.join(drawn, "entity"), REFITS), REFITS))


def refitted_risks(states: DataFrame, models: DataFrame, replicates: int) -> DataFrame:
    """replicate, policy, mean risks, n_copies: every episode as often as drawn (``times``, an array by replicate).

    An episode's risks follow from its fold and its states and clocks alone, whatever their order. Episodes alike in these are counted by replicate first; risks are worked out once for each kind
    and replicate, so what is joined to the models and multiplied grows with the kinds of episodes, not with episodes or draws."""
    episodes = states.groupBy("policy", *EPISODE, "fold", "times").agg(F.array_sort(F.collect_list(F.struct(*STATE))).alias("steps"))
    kinds = episodes.groupBy("policy", "fold", "steps").agg(F.array(*[F.sum(F.col("times")[r]) for r in range(replicates)]).alias("times"))
    kinds = cut(kinds.withColumn("kind", F.monotonically_increasing_id()))  # numbered once
    steps = asked(kinds.select("kind", "fold", F.explode("steps").alias("s")).groupBy("kind", "fold", "s").agg(F.count("*").alias("n")).select("kind", "fold", "n", "s.*"))
    weights = kinds.select("kind", "policy", F.posexplode("times").alias("replicate", "times")).where("times > 0").withColumn("replicate", F.col("replicate").cast("bigint"))
    known = hazard(looked_up(steps.join(weights, "kind"), models, ("replicate",)))
    risk = lambda o: (1 - F.product(F.when(F.col("outcome") == o, F.pow(1 - F.col("hazard"), F.col("n"))))).alias(f"risk_{o}")
    risks = known.groupBy("kind", "policy", "replicate", "times").agg(*[risk(o) for o in HAZARD_OUTCOMES])
    return risks.groupBy("replicate", "policy").agg(*[(F.sum(F.col("times") * F.col(f"risk_{o}")) / F.sum("times")).alias(f"risk_{o}") for o in HAZARD_OUTCOMES], F.sum("times").alias("n_copies"))


@query(f"WITH {TARGETS}, {DRAWN} SELECT replicate, count(*) AS n_rows, count(DISTINCT (entity, copy)) AS n_trajectory_groups, max(copy) AS most_copies FROM (SELECT replicate, entity, unnest(range(0, times)) AS copy FROM dr) GROUP BY replicate")
def bootstrap_copies(spark, folder):
    """Drawn entities as rows, every copy a trajectory of its own."""
    rows, drawn = drawn_rows(spark, folder)
    copies = bootstrap.copies(rows, drawn)
    return copies.groupBy("replicate").agg(F.count("*").alias("n_rows"), F.count_distinct("entity", "copy").alias("n_trajectory_groups"), F.max("copy").alias("most_copies"))


# Stacking

CELLS = ("g_day", "hour_cell")


def stacked(spark: SparkSession, folder: str) -> DataFrame:
    """Decision rows with the inner and outer predictions of two rate models, and the nested weight: fold, y, p_*, weight, p.

    Inner: for outer fold k a row of fold j is predicted from the folds outside {j, k}, and the weight is chosen on those predictions alone.
    Outer: both models are fitted anew on all folds but k, and fold k gets their combination. A training part with one class gives its smoothed rate.
    """
    rows = scored_decisions(spark, folder).select(*EPISODE, "episode_index", "fold", "g_day", F.pmod(F.floor(F.col("period_start") / 3_600_000_000 / 6), F.lit(4)).alias("hour_cell"), F.col("removed_in").alias("y"))
    rows = cut(rows)  # read by every fit
    inner = rows.withColumn("outer", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint")))).where("outer <> fold")
    outer = rows
    for c in CELLS:
        inner = inner.join(rates.crossfit_rates(inner, ["outer", c], "y").withColumnRenamed("p", f"i_{c}"), ["fold", "outer", c])
        outer = outer.join(rates.crossfit_rates(rows, [c], "y").withColumnRenamed("p", f"p_{c}"), ["fold", c])
    weights = rates.stacked_weight(inner, ["outer"], F.col("i_g_day"), F.col("i_hour_cell"), F.col("y")).withColumnRenamed("outer", "fold")
    return outer.join(F.broadcast(weights), "fold").withColumn("p", F.col("weight") * F.col("p_g_day") + (1 - F.col("weight")) * F.col("p_hour_cell"))  # a row for each fold


def _stack_sql() -> str:
    cells = {"g_day": "least(episode_day, 6)", "hour_cell": "CAST(floor(period_start / 3600000000.0 / 6) AS BIGINT) % 4"}
    parts = [SCORES[: SCORES.index("prop_own")].rstrip().rstrip(","), f"st AS (SELECT *, removed_in AS y, {', '.join(f'{e} AS {k}' for k, e in cells.items())} FROM decf)", "inn AS (SELECT st.*, o.i AS ofold FROM st, (SELECT unnest(range(0, 5)) AS i) o WHERE o.i <> fold)"]
    for c in CELLS:
        parts += [oracle.crossfit(f"i_{c}", "inn", {"ofold": "ofold", c: c}, "y"), oracle.crossfit(f"o_{c}", "st", {c: c}, "y")]
    join = lambda pre, rows, more: f"{rows} JOIN {pre}_g_day a ON a.fold = {rows}.fold AND a.g_day = {rows}.g_day{more.format('a')} JOIN {pre}_hour_cell b ON b.fold = {rows}.fold AND b.hour_cell = {rows}.hour_cell{more.format('b')}"
    parts.append(f"w AS (SELECT inn.ofold AS fold, greatest(0, least(1, sum((a.p - b.p) * (y - b.p)) / sum((a.p - b.p) * (a.p - b.p)))) AS weight FROM {join('i', 'inn', ' AND {0}.ofold = inn.ofold')} GROUP BY 1)")
    parts.append(f"done AS (SELECT st.*, weight, a.p AS p_g_day, b.p AS p_hour_cell, weight * a.p + (1 - weight) * b.p AS p FROM {join('o', 'st', '')} JOIN w ON w.fold = st.fold)")
    return ", ".join(parts).replace(", st AS", ",\nst AS", 1)


@query(f"WITH {_stack_sql()} SELECT fold, round(weight, 5) AS weight, count(*) AS n, round(avg((y - p) * (y - p)), 6) AS brier, round(avg((y - p_g_day) * (y - p_g_day)), 6) AS brier_g_day, round(avg((y - p_hour_cell) * (y - p_hour_cell)), 6) AS brier_hour_cell FROM done GROUP BY fold, weight")
def nested_stacking(spark, folder):
    """Weights and held-out squared errors by fold of a nested convex combination."""
    loss = lambda p: F.avg((F.col("y") - F.col(p)) ** 2)
    found = stacked(spark, folder).groupBy("fold", "weight").agg(F.count("*").alias("n"), loss("p").alias("brier"), *[loss(f"p_{c}").alias(f"brier_{c}") for c in CELLS])
    return found.select("fold", F.round("weight", 5).alias("weight"), "n", *[F.round(c, 6).alias(c) for c in found.columns if c.startswith("brier")])


# Tree ensembles

TREE_FEATURES = ["episode_day", "interval_hours", *[f"{i}__{st}" for i in ("click", "view") for st in ("count", "mean", "last")]]


def tree_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Decision rows with folds and look-back features as they are: missing where nothing was measured."""
    rows = decision_rows(spark, folder)
    wide = features.wide(rows, features.lookback(cleaned(spark, folder), rows), WIDE)
    return cut(wide.select(*EPISODE, "episode_index", "fold", "removed_in", "reward_exposure_days", *[F.col(c).cast("double").alias(c) for c in TREE_FEATURES]))


@query()
def boosted_propensity(spark, folder):
    """Out-of-fold removal probabilities by boosted trees that send missing values where they gain most."""
    rows = tree_rows(spark, folder)
    return rounded(trees.boosted(rows, TREE_FEATURES, "removed_in", trees=12).score(rows, "p").select(*EPISODE, "episode_index", "fold", "removed_in", "p"))


@query()
def extra_trees_days(spark, folder):
    """Out-of-fold exposure days of a decision by extremely randomised trees."""
    rows = tree_rows(spark, folder)
    return rounded(trees.extra(rows, TREE_FEATURES, "reward_exposure_days", trees=10).score(rows, "predicted").select(*EPISODE, "episode_index", "fold", "reward_exposure_days", "predicted"))


# Tables about fits

_DECF = SCORES[: SCORES.index("prop_own")].rstrip().rstrip(",")


@query(f"WITH {SCORES} SELECT action_removed, bin, count(*) AS n, round(avg(g), 6) AS mean_g, round(avg(outcome_seen), 6) AS rate FROM (SELECT removed_in AS action_removed, CAST(least(floor(prop.p * 20), 19) AS BIGINT) AS bin, prop.p AS g, reward_outcome AS outcome_seen FROM decf JOIN prop ON g_day = least(episode_day, 6) AND prop.fold = decf.fold) GROUP BY ALL")
def calibration_by_action(spark, folder):
    """The outcome's rate by bins of the propensity, for either observed action."""
    rows = scored_decisions(spark, folder).withColumn("bin", F.least(F.floor(F.col("g") * 20), F.lit(19)).cast("bigint"))
    return rounded(rows.groupBy("action_removed", "bin").agg(F.count("*").alias("n"), F.avg("g").alias("mean_g"), F.avg("reward").alias("rate")))


@query(f"WITH {_DECF} SELECT k AS fold, count(DISTINCT entity) FILTER (WHERE fold <> k) AS train_entities, count(DISTINCT entity) FILTER (WHERE fold = k) AS held_entities, count(*) FILTER (WHERE fold <> k) AS train_rows, count(*) FILTER (WHERE fold = k) AS held_rows, sum(removed_in) FILTER (WHERE fold <> k)::BIGINT AS train_events, (SELECT count(*) FROM (SELECT entity FROM decf GROUP BY entity HAVING count(DISTINCT fold) > 1)) AS shared_entities FROM decf, (SELECT unnest(range(0, 5)) AS k) GROUP BY k")
def fit_audit(spark, folder):
    """Members of each fit: entities and rows of training and held-out parts, and entities that are in both."""
    return folds.audit(scored_decisions(spark, folder).select("entity", "fold", "removed_in"), "removed_in")


@query("WITH e AS (SELECT user_id AS entity, CASE WHEN user_id % 3 = 0 THEN event_id % 4 ELSE user_id % 4 END AS fold FROM events) SELECT (SELECT count(*) FROM (SELECT entity FROM e GROUP BY entity HAVING count(DISTINCT fold) > 1)) AS groups_in_several_folds, (SELECT count(DISTINCT fold) FROM e) AS n_folds")
def fold_faults(spark, folder):
    """Planted: a third of the entities are in several folds."""
    ev = tables.events(spark, folder)
    return folds.fold_violations(ev.select("entity", F.when(F.col("entity") % 3 == 0, F.col("event_id") % 4).otherwise(F.col("entity") % 4).alias("fold")))


# Checks with planted faults


@query("SELECT count(*) FILTER (WHERE p IS NULL OR isnan(p) OR p < 0 OR p > 1) AS bad_probability, count(*) FILTER (WHERE f NOT IN (0, 1)) AS bad_flag, count(*) FILTER (WHERE s NOT IN ('in', 'out')) AS unknown_state FROM (SELECT CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'nan'::DOUBLE WHEN 2 THEN -0.1 ELSE value / 100 END AS p, event_id % 3 AS f, CASE WHEN event_id % 5 = 0 THEN 'gone' ELSE 'in' END AS s FROM events)")
def input_faults(spark, folder):
    """Planted: probabilities, flags and states that a reader must refuse."""
    ev = tables.table(spark, folder, "events")
    k = F.col("event_id") % 11
    rows = ev.select(F.when(k == 0, None).when(k == 1, float("nan")).when(k == 2, -0.1).otherwise(F.col("value") / 100).alias("p"), (F.col("event_id") % 3).alias("f"), F.when(F.col("event_id") % 5 == 0, "gone").otherwise("in").alias("state"))
    return checks.violations(rows, {"bad_probability": checks.bad_probability("p"), "bad_flag": checks.bad_flag("f"), "unknown_state": ~F.col("state").isin("in", "out")})


_FAULTY = "fp AS (SELECT entity, inserted, episode_index + CASE WHEN entity % 7 = 0 AND episode_index > 0 THEN 1 ELSE 0 END AS episode_index, period_start + CASE WHEN entity % 11 = 0 AND episode_index = 1 THEN 1 ELSE 0 END AS period_start, period_end, (is_decision OR (entity % 5 = 0 AND final_row)) AND entity % 13 <> 0 AS is_decision FROM (SELECT *, period_end = episode_end AS final_row FROM panel)), fw AS (SELECT *, lag(episode_index) OVER w AS b, lag(is_decision) OVER w AS was, lag(period_end) OVER w AS e, is_decision AND NOT coalesce(lead(is_decision) OVER w, false) AS last FROM fp WINDOW w AS (PARTITION BY entity, inserted ORDER BY episode_index))"


@query(f"WITH {oracle.PANEL}, {_FAULTY} SELECT count(*) FILTER (WHERE episode_index <> coalesce(b + 1, 0)) AS broken_index, count(*) FILTER (WHERE e <> period_start) AS gaps, count(*) FILTER (WHERE is_decision AND NOT was) AS decision_after_exit, count(*) FILTER (WHERE b IS NULL AND NOT is_decision) AS starts_outside, count(*) FILTER (WHERE is_decision AND episode_index >= 10) AS beyond_horizon, (SELECT count(*) FROM (SELECT entity FROM fw GROUP BY entity, inserted HAVING count(*) FILTER (WHERE last) = 0)) AS no_last_decision, (SELECT count(*) FROM (SELECT entity FROM fw GROUP BY entity, inserted HAVING count(*) FILTER (WHERE last) > 1)) AS several_last_decisions FROM fw")
def decision_faults(spark, folder):
    """Planted: skipped periods, gaps, decisions after the exit, episodes without a decision."""
    rows = base(spark, folder)
    first = F.col("episode_index")
    broken = rows.select(*EPISODE, (first + F.when((F.col("entity") % 7 == 0) & (first > 0), 1).otherwise(0)).alias("episode_index"), (F.col("period_start") + F.when((F.col("entity") % 11 == 0) & (first == 1), 1).otherwise(0)).alias("period_start"), "period_end", ((F.col("is_decision") | (F.col("entity") % 5 == 0) & (F.col("period_end") == F.col("episode_end"))) & (F.col("entity") % 13 != 0)).alias("is_decision"))
    return checks.decision_faults(broken, EPISODE, horizon=10)


_CHOOSE = "lgamma({0} + 1) - lgamma({1} + 1) - lgamma({0} - {1} + 1)"
_LOG_P = f"({_CHOOSE.format('rw', 'k')}) + ({_CHOOSE.format('(n - rw)', '(cl - k)')}) - ({_CHOOSE.format('n', 'cl')})"


#: Twice the upper tail of a standard normal, by Simpson's rule on [0, z].
_TAIL = "greatest(0, 1 - 2 * z / 6000 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 2001), lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(z * i / 2000) * (z * i / 2000) / 2))))"


@query(
    "WITH c AS (SELECT l_suppkey, count(*) FILTER (WHERE a AND b) AS n11, count(*) FILTER (WHERE a AND NOT b) AS n10, count(*) FILTER (WHERE NOT a AND b) AS n01, count(*) FILTER (WHERE NOT a AND NOT b) AS n00 FROM (SELECT l_suppkey, l_quantity > 45 AS a, l_discount > 0.08 AS b FROM lineitem) GROUP BY 1), "
    "m AS (SELECT *, n11 + n10 AS rw, n11 + n01 AS cl, n11 + n10 + n01 + n00 AS n FROM c), "
    f"lp AS (SELECT l_suppkey, n11, k, {_LOG_P} AS lp FROM (SELECT *, unnest(range(greatest(0, rw + cl - n), least(rw, cl) + 1)) AS k FROM m)), "
    "fp AS (SELECT l_suppkey, least(1, sum(exp(lp)) FILTER (WHERE lp <= own + 1e-7)) AS p FROM (SELECT *, max(CASE WHEN k = n11 THEN lp END) OVER (PARTITION BY l_suppkey) AS own FROM lp) GROUP BY 1), "
    "x AS (SELECT m.*, p, n * pow(n11 * n00 - n10 * n01, 2) / nullif((n11 + n10) * (n01 + n00) * (n11 + n01) * (n10 + n00), 0)::DOUBLE AS chi FROM m JOIN fp USING (l_suppkey)) "
    f"SELECT l_suppkey, n11, n10, n01, n00, round(n11 * n00 / nullif(n10 * n01, 0)::DOUBLE, 6) AS odds_ratio, round(chi, 6) AS chi_squared, round(p, 6) AS fisher_p, round({_TAIL}, 6) AS chi_squared_p FROM (SELECT *, sqrt(chi) AS z FROM x)"
)
def fisher_tests(spark, folder):
    """Two-by-two tables of all rows by supplier with the exact two-sided p and the chi-squared one."""
    rows = tables.table(spark, folder, "lineitem").select("l_suppkey", (F.col("l_quantity") > 45).cast("int").alias("a"), (F.col("l_discount") > 0.08).cast("int").alias("b"))
    return rounded(metrics.fisher_p(metrics.two_by_two(rows, "l_suppkey", "a", "b")).drop("risk_difference"))


# Columns

LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


@query("SELECT o_orderstatus, " + ", ".join(f"sum(CASE WHEN o_orderpriority = '{v}' THEN 1 ELSE 0 END)::BIGINT AS \"is_{v}\"" for v in LEVELS) + ", count(*) AS n FROM orders GROUP BY 1")
def one_hot_levels(spark, folder):
    """A 0/1 column for each explicit level, summed by group."""
    coded = tables.table(spark, folder, "orders").select("o_orderstatus", *checks.one_hot("o_orderpriority", LEVELS, "is"))
    return coded.groupBy("o_orderstatus").agg(*[F.sum(c).alias(c) for c in checks.named_like(coded, "is_.*")], F.count("*").alias("n"))


@query("SELECT b, count(*) AS n, sum(CASE WHEN o_totalprice IS NULL THEN 1 ELSE 0 END)::BIGINT AS n_blank FROM (SELECT CASE lower(trim(x)) WHEN 'true' THEN true WHEN 'no' THEN false END AS b, NULL AS o_totalprice FROM (SELECT CASE o_orderstatus WHEN 'F' THEN ' TRUE ' WHEN 'O' THEN 'no' ELSE 'maybe' END AS x FROM orders)) GROUP BY 1")
def parsed_and_blanked(spark, folder):
    """Booleans read from text, and a block of columns blanked by the pattern of its name."""
    rows = checks.blanked(tables.table(spark, folder, "orders"), "o_total.*")
    text = F.when(F.col("o_orderstatus") == "F", " TRUE ").when(F.col("o_orderstatus") == "O", "no").otherwise("maybe")
    return rows.select(checks.parsed_boolean(text).alias("b"), "o_totalprice").groupBy("b").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").isNull().cast("int")).alias("n_blank"))


def _sum60(i: int) -> str:
    return f"sum(CAST('0x' || substr(h, {15 * i + 1}, 15) AS BIGINT))::VARCHAR"


@query("SELECT sha256('9:p_partkey:bigint,7:p_brand:string,6:p_size:int;' || count(*) || ';' || " + " || ';' || ".join(map(_sum60, range(4))) + ") AS fingerprint, count(*) AS n FROM (SELECT sha256(length(p_partkey::VARCHAR) || ':' || p_partkey || length(p_brand) || ':' || p_brand || length(p_size::VARCHAR) || ':' || p_size) AS h FROM part)")
def content_fingerprint(spark, folder):
    """The fingerprint of a table's contents, for cache keys."""
    rows = tables.table(spark, folder, "part").select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_brand", F.col("p_size").cast("int").alias("p_size"))
    return checks.content_fingerprint(rows, ["p_partkey", "p_brand", "p_size"])
