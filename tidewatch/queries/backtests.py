"""Backtests with calibrated cuts, models of several horizons, and maps of state histories: K4, K5, K36 to K40."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import backtest as B
from ..plans.tables import stored
from .learn import standard
from .replay import FEATURES, LB, labelled
from .windows import rounded

QUERIES, ORACLE_SQL = {}, {}
HORIZON, SCENARIOS, FPR = 3, 5, 0.05
ATTACKS = ["Exfiltration", "Lateral Movement", "Reconnaissance"]


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def in_time(rows):
    """rows with order: by place, then scenario."""
    return rows.withColumn("order", F.col("idx") * SCENARIOS + F.col("scenario"))


GRID = "gr AS (SELECT unnest([" + ", ".join(f"{c}E0" for c in B.GRID) + "]) AS threshold)"
#: Per fold: the cut of the best F1 of the rows va (fold, p, truth), the lowest on ties, 0.5 with one class.
CUTS = """f1 AS (SELECT fold, threshold, count(*) FILTER (p >= threshold AND truth) AS tp, count(*) FILTER (p >= threshold AND NOT truth) AS fp, count(*) FILTER (p < threshold AND truth) AS fn, count(*) FILTER (p < threshold AND NOT truth) AS tn FROM va, gr GROUP BY fold, threshold),
ct AS (SELECT fold, CASE WHEN tp + fn > 0 AND fp + tn > 0 THEN threshold ELSE 0.5E0 END AS threshold FROM f1 QUALIFY row_number() OVER (PARTITION BY fold ORDER BY round(coalesce(2E0 * tp / nullif(2 * tp + fp + fn, 0), 0), 12) DESC, threshold) = 1)"""


def _later(h: int) -> str:
    return f"CASE WHEN p >= 0.5 THEN 0.5E0 + abs(p - 0.5E0) * 0.85E0 ** {h} ELSE 0.5E0 - abs(p - 0.5E0) * 0.85E0 ** {h} END"


#: Rates per fold (and kind) of the walked rows te (fold, kind, scenario, idx, infiltration, p, threshold).
WALK = f"""pl AS (SELECT *, row_number() OVER o - 1 AS place FROM te WINDOW o AS (PARTITION BY fold, kind, scenario ORDER BY idx)),
wk AS (SELECT *, CASE WHEN p >= threshold THEN 0 WHEN {_later(1)} >= threshold THEN 1 WHEN {_later(2)} >= threshold THEN 2 END AS crossing, max(infiltration) OVER a AS realized, count(*) OVER a AS seen,
  min(CASE WHEN infiltration THEN place END) OVER a - place - 1 AS late, min(CASE WHEN infiltration THEN place END) OVER (PARTITION BY fold, kind, scenario) AS onset FROM pl
  WINDOW a AS (PARTITION BY fold, kind, scenario ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
fo AS (SELECT *, crossing IS NOT NULL AS crossed, CASE WHEN crossing <= late THEN late - crossing END AS lead, CASE WHEN place < onset THEN 'PRE' WHEN place < onset + 3 THEN 'DURING' END AS phase FROM wk WHERE place >= 1 AND seen = 3),
ra AS (SELECT fold, kind, max(threshold) AS threshold, count(*) AS forecasts, avg((crossed = realized)::INT) AS direction_accuracy, avg(crossed::INT) AS crossing_rate, avg((crossed AND NOT realized)::INT) AS false_early_rate,
  coalesce(avg(crossed::INT) FILTER (phase = 'PRE'), 0) AS pre_onset_rate, coalesce(avg(crossed::INT) FILTER (phase = 'DURING'), 0) AS during_attack_rate, median(lead) AS median_lead FROM fo GROUP BY fold, kind)"""
RATES = "round(threshold, 6) AS threshold, forecasts, round(direction_accuracy, 6) AS direction_accuracy, round(crossing_rate, 6) AS crossing_rate, round(false_early_rate, 6) AS false_early_rate, round(pre_onset_rate, 6) AS pre_onset_rate, round(during_attack_rate, 6) AS during_attack_rate, median_lead"


@query("k37_rolling_origin")
def k37(spark, sf_dir):
    """Models of the earlier scenarios, their threshold from the next one, replay and drift on the one after it, at each origin."""
    rows = labelled(spark, sf_dir)
    return rounded(B.backtest(rows, FEATURES, B.rolling_folds(list(range(SCENARIOS))), HORIZON))


@query("k37_calibrated_replay", f"WITH {LB}, tg AS (SELECT *, lead(infiltration, 3) OVER (PARTITION BY scenario ORDER BY idx) AS truth FROM lb), og AS (SELECT unnest(range({SCENARIOS - 2})) AS o), {GRID}, va AS (SELECT o AS fold, p, truth FROM tg JOIN og ON scenario = o + 1 WHERE truth IS NOT NULL AND idx >= 1), {CUTS}, te AS (SELECT o AS fold, '' AS kind, scenario, idx, infiltration, p, coalesce(threshold, 0.5E0) AS threshold FROM lb JOIN og ON scenario = o + 2 LEFT JOIN ct ON ct.fold = o), {WALK} SELECT CAST(fold AS VARCHAR) AS fold, {RATES} FROM ra")
def k37_rates(spark, sf_dir):
    """The same folds with the rules' score instead of a model's: thresholds and replay of all origins in one pass."""
    rows = B.with_target(labelled(spark, sf_dir).withColumn("score", F.col("p")), HORIZON)
    parts = [F.when(f.test, F.struct(F.lit(f.name).alias("fold"), F.lit("test").alias("part"))).when(f.validation, F.struct(F.lit(f.name).alias("fold"), F.lit("validation").alias("part"))) for f in B.rolling_folds(list(range(SCENARIOS)))]
    scored = rows.withColumn("x", F.explode(F.array_compact(F.array(*parts)))).select("*", "x.fold", "x.part").drop("x")
    return rounded(B.judged(stored(scored, "rates"), F.col("target").isNotNull() & (F.col("idx") >= 1), HORIZON))


@query("k36_leave_one_stage_out")
def k36(spark, sf_dir):
    """Each attack stage judged by a model and a cut that never saw it."""
    rows = in_time(labelled(spark, sf_dir)).withColumn("label", F.col("infiltration"))
    stages = sorted(r["stage"] for r in rows.where("label").select("stage").distinct().collect())  # a row per stage
    return rounded(B.leave_one_stage_out(rows, FEATURES, stages, FPR))


K36 = f"""WITH {LB}, hs AS (SELECT unnest({ATTACKS}) AS fold), al AS (SELECT * REPLACE (round(p, 9) AS p), idx * {SCENARIOS} + scenario AS o FROM lb),
ot AS (SELECT fold, p, infiltration, row_number() OVER (PARTITION BY fold ORDER BY o) - 1 AS r, count(*) OVER (PARTITION BY fold) AS n FROM al JOIN hs ON stage <> fold),
pa AS (SELECT fold, 'calibration' AS part, p, infiltration FROM ot WHERE r >= floor(n * 0.7E0) UNION ALL SELECT fold, 'benign', p, infiltration FROM al, hs WHERE stage = 'Benign' UNION ALL SELECT fold, 'held', p, infiltration FROM al JOIN hs ON stage = fold),
ng AS (SELECT fold, part, p, row_number() OVER (PARTITION BY fold, part ORDER BY p DESC) AS r, floor(count(*) OVER (PARTITION BY fold, part) * {FPR}E0) AS allowed, max(p) OVER (PARTITION BY fold, part) AS top FROM pa WHERE part = 'benign' OR part = 'calibration' AND NOT infiltration),
cu AS (SELECT fold, coalesce(max(CASE WHEN part = 'calibration' AND r = allowed THEN p END), max(CASE WHEN part = 'calibration' THEN top END) + 1e-9, 0.5E0) AS threshold, coalesce(max(CASE WHEN part = 'benign' AND r = allowed THEN p END), max(CASE WHEN part = 'benign' THEN top END) + 1e-9) AS best FROM ng GROUP BY fold),
au AS (SELECT fold, (sum(r) FILTER (part = 'held') - count(*) FILTER (part = 'held') * (count(*) FILTER (part = 'held') + 1) / 2E0) / nullif(count(*) FILTER (part = 'held') * count(*) FILTER (part = 'benign'), 0) AS roc_auc FROM (SELECT fold, part, rank() OVER (PARTITION BY fold ORDER BY p) + (count(*) OVER (PARTITION BY fold, p) - 1) / 2E0 AS r FROM pa WHERE part <> 'calibration') GROUP BY fold)
SELECT fold, count(*) FILTER (part = 'calibration') AS calibration_windows, count(*) FILTER (part = 'benign') AS benign_windows, count(*) FILTER (part = 'held') AS held_windows, round(max(threshold), 6) AS threshold,
 round(avg((p >= threshold)::INT) FILTER (part = 'benign'), 6) AS benign_fpr, round(avg((p >= threshold)::INT) FILTER (part = 'held'), 6) AS detection, round(avg((p >= best)::INT) FILTER (part = 'held'), 6) AS ceiling,
 round(avg(p) FILTER (part = 'held'), 6) AS mean_score, round(max(p) FILTER (part = 'held'), 6) AS max_score, round(max(roc_auc), 6) AS roc_auc FROM (SELECT pa.*, coalesce(cu.threshold, 0.5E0) AS threshold, best, roc_auc FROM pa LEFT JOIN cu USING (fold) LEFT JOIN au USING (fold)) GROUP BY fold"""


@query("k36_stage_cuts", K36)
def k36_cuts(spark, sf_dir):
    """The same report with the rules' score instead of a model's."""
    placed, _, parts = B.stage_roles(in_time(labelled(spark, sf_dir)), ATTACKS)
    each = F.array(*[F.when(parts[s].isNotNull(), F.struct(F.lit(s).alias("fold"), parts[s].alias("parts"))) for s in ATTACKS])
    scored = placed.select("p", "infiltration", F.explode(F.array_compact(each)).alias("x")).select("x.fold", F.explode("x.parts").alias("part"), F.round("p", 9).alias("score"), F.col("infiltration").alias("truth"))  # equal scores stay equal however they were summed
    return rounded(B.cut_report(stored(scored, "stage-cuts"), FPR))


def periods(rows):
    """rows with period 0 to 3, quarters of the time."""
    last = rows.agg(F.max("idx")).first()[0] + 1
    return rows.withColumn("period", F.floor(F.col("idx") * 4 / last).cast("int"))


TEST_PERIODS = (2, 3)


def cross_period(test: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rates per test period, at the calibrated threshold and at 0.5; test: period, timeline and states."""
    both = test.withColumn("fold", F.col("period").cast("string")).crossJoin(F.broadcast(cuts.select("threshold")))  # one row
    kinds = F.explode(F.array(F.struct(F.lit("calibrated").alias("kind"), F.col("threshold").alias("t")), F.struct(F.lit("half").alias("kind"), F.lit(0.5).alias("t"))))
    rows = both.withColumn("x", kinds).drop("threshold").select("*", F.col("x.kind").alias("kind"), F.col("x.t").alias("threshold")).drop("x")
    keys = ["fold", "kind"]
    return rows.groupBy(*keys).agg(F.max("threshold").alias("threshold")).join(B.walk_rates(B.walked(rows, HORIZON, keys), keys), keys)


def validation_cut(rows):
    """The threshold of period 1: scores there against labels three states on in the same period."""
    one = B.with_target(rows.where("period = 1"), HORIZON).where("target is not null")
    return B.cut_by_f1(one.select(F.lit(1).alias("g"), "score", F.col("target").alias("truth")), ["g"])


@query("k38_cross_period")
def k38(spark, sf_dir):
    """Trained on the first quarter, its threshold from the second, tested on each later one: by the decayed classifier and by the rolled-out states."""
    rows = stored(periods(standard(spark, sf_dir)), "periods")
    train = rows.where("period = 0")
    model = B.fitted(B.with_target(train, HORIZON).where("target is not null"), FEATURES, constant=True)
    if model is None:
        raise ValueError("the first quarter has no row with a target")
    scored = stored(rows.withColumn("score", model.score(B.values(FEATURES))), "period-scores")
    cuts = stored(validation_cut(scored), "period-cut")
    test = scored.where(F.col("period").isin(*TEST_PERIODS))
    own = cross_period(test.withColumn("timeline", B.decayed(F.col("score"), HORIZON)), cuts).withColumn("forecaster", F.lit("decay"))
    known = B.fit_history_map(train, FEATURES)
    rolled = B.rolled_timeline(B.rolled_out(test, FEATURES, known, HORIZON), FEATURES, model)
    return rounded(own.unionByName(cross_period(rolled, cuts).withColumn("forecaster", F.lit("rollout"))))


@query("k38_calibrated_periods", f"WITH {LB}, pe AS (SELECT *, floor(idx * 4E0 / (max(idx) OVER () + 1))::INT AS period FROM lb), {GRID}, va AS (SELECT 1 AS fold, p, truth FROM (SELECT p, lead(infiltration, 3) OVER (PARTITION BY scenario ORDER BY idx) AS truth FROM pe WHERE period = 1) WHERE truth IS NOT NULL), {CUTS}, te AS (SELECT period AS fold, kind, scenario, idx, infiltration, p, CASE WHEN kind = 'half' THEN 0.5E0 ELSE threshold END AS threshold FROM pe, ct, (SELECT unnest(['calibrated', 'half']) AS kind) WHERE period >= 2), {WALK} SELECT CAST(fold AS VARCHAR) AS fold, kind, {RATES} FROM ra")
def k38_rates(spark, sf_dir):
    """The same protocol with the rules' score."""
    rows = stored(periods(labelled(spark, sf_dir)).withColumn("score", F.col("p")), "periods")
    test = rows.where(F.col("period").isin(*TEST_PERIODS)).withColumn("timeline", B.decayed(F.col("score"), HORIZON))
    return rounded(cross_period(test, validation_cut(rows)))


LENGTH, HORIZONS = 4, 5


def horizon_fit(spark, sf_dir):
    rows, names, models = B.horizon_models(standard(spark, sf_dir), FEATURES, LENGTH, HORIZONS, F.col("scenario") < 3)
    return rows.where("scenario >= 3"), names, models


@query("k4_horizon_classifiers")
def k4(spark, sf_dir):
    """A model for each horizon over the last four states, all applied in one scan."""
    return rounded(B.horizon_scores(*horizon_fit(spark, sf_dir)).select("scenario", "idx", "horizon", "score"))


@query("k5_model_timeline")
def k5(spark, sf_dir):
    """Timeline of the horizons' models (one of them left out, so decayed), with lead, stage and warnings."""
    rows, names, models = horizon_fit(spark, sf_dir)
    base = B.fitted(standard(spark, sf_dir).where("scenario < 3 AND label IS NOT NULL"), FEATURES, "label", constant=True)
    models.pop(HORIZONS, None)
    shown = rows.withColumn("has_packets", F.lit(False))
    out = B.forecast_timeline(shown, names, models, base.score(B.values(FEATURES)), HORIZONS, 0.5)
    return rounded(out.select("scenario", "idx", *[F.round(F.col("timeline")[h], 6).alias(f"h{h + 1}") for h in range(HORIZONS)], "lead", "peak", "predicted_stage", F.array_join("warnings", ",").alias("warnings")))


def history_map(spark, sf_dir):
    rows = standard(spark, sf_dir)
    return rows, B.fit_history_map(rows.where("scenario < 3"), FEATURES)


@query("k39_transition_model")
def k39(spark, sf_dir):
    """Error of the map of three states against persistence, one to three states ahead."""
    rows, known = history_map(spark, sf_dir)
    long = B.rollout_errors(B.rolled_out(rows.where("scenario >= 3"), FEATURES, known, HORIZON), HORIZON).where("m is not null")
    out = long.groupBy("step").agg(F.avg("m").alias("error"), F.avg("q").alias("persistence"))
    return rounded(out.withColumn("skill", F.when(F.col("persistence") > 0, 1 - F.col("error") / F.col("persistence"))))


@query("k40_open_loop_rollout")
def k40(spark, sf_dir):
    """The simulated states classified: error and skill, mean probability and flagged windows at each step."""
    rows, known = history_map(spark, sf_dir)
    model = B.fitted(rows.where("scenario < 3"), FEATURES, "label", constant=True)
    if model is None:
        raise ValueError("the training scenarios have no rows")
    long = B.rollout_errors(B.rolled_out(rows.where("scenario >= 3"), FEATURES, known, HORIZON), HORIZON)
    score = model.score([F.col("state")[i] for i in range(len(FEATURES))])
    out = long.withColumn("score", score).groupBy("step").agg(F.avg("m").alias("error"), F.avg("q").alias("persistence"), F.count("*").alias("windows"), F.avg("score").alias("mean_score"), F.count_if(F.col("score") >= 0.5).alias("flagged"))
    return rounded(out.withColumn("skill", F.when(F.col("persistence") > 0, 1 - F.col("error") / F.col("persistence"))))
