"""Labels, samples, splits, replay and forecasts: B3, B4, B10, C1, C2, C9, C12, D26, E4 to E9, F1, F2, F4, G4, H6, H13, K1, K2, K5, K6, K10, K11, K41."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import replay as R
from ..operators import windows as W
from .detect import LABEL, SCORED, scored
from .windows import members, rounded

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


LB = f"{SCORED}, {LABEL}, lb AS (SELECT p.scenario, p.k, p.idx, wl.stage, wl.stage <> 'Benign' AS infiltration, greatest(0.02E0, least(0.98E0, p_ddos + p_insider_threat / 2)) AS p, bytes, failed_auth, event_count, rst_count, retransmission, tunnel FROM p JOIN wl USING (scenario, k))"


def labelled(spark, sf_dir):
    """States with their label and a score."""
    rows = scored(spark, sf_dir).join(W.window_label(members(spark, sf_dir)), ["scenario", "k"])
    p = F.greatest(F.lit(0.02), F.least(F.lit(0.98), F.col("p_ddos") + F.col("p_insider_threat") / 2))
    return rows.select("scenario", "k", "idx", "stage", "infiltration", p.alias("p"), "bytes", "failed_auth", "event_count", "rst_count", "retransmission", "tunnel")


@query("e4_future_labels", f"WITH {LB}, f AS (SELECT scenario, idx, lead(idx, 3) OVER w AS target_idx, lead(stage, 3) OVER w AS target_stage, lead(infiltration, 3) OVER w AS target FROM lb WINDOW w AS (PARTITION BY scenario ORDER BY idx)) SELECT * FROM f WHERE target_idx IS NOT NULL")
def e4(spark, sf_dir):
    return R.future_label(labelled(spark, sf_dir), 3)


SAMPLES = "sa AS (SELECT scenario, idx, list(scenario || ':' || idx) OVER (PARTITION BY scenario ORDER BY idx ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS inputs, lead(infiltration, 5) OVER (PARTITION BY scenario ORDER BY idx) AS target FROM lb)"


@query("e5_sequence_samples", f"WITH {LB}, {SAMPLES} SELECT scenario, idx, array_to_string(inputs, ' ') AS inputs, target FROM sa WHERE len(inputs) = 8 AND target IS NOT NULL")
def e5(spark, sf_dir):
    return R.samples(labelled(spark, sf_dir), 8, 5).withColumn("inputs", F.array_join("inputs", " "))


@query("e6_stage_sequences", f"WITH {LB}, s AS (SELECT scenario, idx, list(stage) OVER (PARTITION BY scenario ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS stages FROM lb) SELECT scenario, idx, array_to_string(stages, '>') AS stages FROM s WHERE len(stages) = 4 AND NOT list_contains(stages, 'Exfiltration')")
def e6(spark, sf_dir):
    return R.stage_sequences(labelled(spark, sf_dir), 4, ["Benign", "Reconnaissance", "Lateral Movement"]).withColumn("stages", F.array_join("stages", ">"))


REPLAY = """rp AS (SELECT *, p >= 0.5 AS crossed, max(infiltration) OVER a AS realized, lead(stage, 3) OVER o AS realized_stage, min(CASE WHEN infiltration THEN idx END) OVER (PARTITION BY scenario) AS onset,
 count(*) OVER a AS observed, min(CASE WHEN infiltration THEN idx END) OVER a AS first FROM lb WINDOW o AS (PARTITION BY scenario ORDER BY idx), a AS (PARTITION BY scenario ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
ro AS (SELECT *, CASE WHEN onset IS NULL THEN 'NO_ATTACK' WHEN idx < onset THEN 'PRE_ONSET' WHEN idx < onset + 3 THEN 'DURING_ATTACK' ELSE 'POST_ATTACK' END AS phase, CASE WHEN crossed AND realized THEN first - idx - 1 END AS lead FROM rp WHERE idx >= 1 AND observed = 3),
rr AS (SELECT *, min(CASE WHEN crossed THEN idx END) OVER (PARTITION BY scenario ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_crossing FROM ro)"""


def replayed(spark, sf_dir):
    return R.replay(labelled(spark, sf_dir), 3, 0.5)


@query("k10_replay", f"WITH {LB}, {REPLAY} SELECT scenario, idx, crossed, realized, realized_stage, onset, next_crossing, phase, lead FROM rr")
def k10(spark, sf_dir):
    return replayed(spark, sf_dir).select("scenario", "idx", "crossed", "realized", "realized_stage", "onset", "next_crossing", "phase", "lead")


for _name, _columns in (("e7_realized_future", ["realized", "realized_stage"]), ("e8_onset_phase", ["onset", "phase"]), ("e9_lead_credit", ["lead"]), ("c9_next_crossing", ["next_crossing"])):

    def _part(columns):
        return lambda spark, sf_dir: replayed(spark, sf_dir).select("scenario", "idx", *columns)

    query(_name, f"WITH {LB}, {REPLAY} SELECT scenario, idx, {', '.join(_columns)} FROM rr")(_part(_columns))


@query("d26_replay_summary", f"WITH {LB}, {REPLAY} SELECT scenario, count(*) AS states, count(*) FILTER (crossed) AS crossings, count(*) FILTER (realized) AS realized_onsets, count(*) FILTER (crossed AND realized) AS hits, count(*) FILTER (crossed AND NOT realized) AS false_early, round(avg(CAST(crossed = realized AS DOUBLE)), 6) AS accuracy, median(lead) AS median_lead, median(CASE WHEN phase = 'PRE_ONSET' THEN lead END) AS median_pre_onset_lead, count(*) FILTER (crossed AND phase = 'PRE_ONSET') AS pre_onset_warnings, count(*) FILTER (crossed AND phase = 'DURING_ATTACK') AS during_attack_detections, count(*) FILTER (crossed AND phase = 'POST_ATTACK') AS post_attack_predictions, min(onset) AS onset FROM rr GROUP BY scenario")
def d26(spark, sf_dir):
    return rounded(R.replay_summary(replayed(spark, sf_dir)))


@query("k11_survival_records", f"WITH {LB}, {REPLAY}, l AS (SELECT *, max(idx) OVER (PARTITION BY scenario) AS last FROM rr) SELECT scenario, idx, coalesce(next_crossing, last + 1) - idx AS duration, next_crossing IS NOT NULL AS event FROM l WHERE realized")
def k11(spark, sf_dir):
    return R.survival_records(replayed(spark, sf_dir))


def customers(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("scenario"), F.col("c_mktsegment").alias("stage"))


DRAW = "CAST('0x' || substr(md5('42:' || c_custkey), 1, 15) AS BIGINT)"


@query("k1_scenario_split", f"WITH d AS (SELECT c_custkey AS scenario, row_number() OVER (ORDER BY {DRAW}) AS r, count(*) OVER () AS n FROM customer) SELECT scenario, CASE WHEN r <= greatest(1, least(floor(n * 0.6E0), n - 2)) THEN 'train' WHEN r <= greatest(greatest(1, least(floor(n * 0.6E0), n - 2)) + 1, least(floor(n * (0.6E0 + 0.2E0)), n - 1)) THEN 'validation' ELSE 'test' END AS split FROM d")
def k1(spark, sf_dir):
    return R.split_scenarios(customers(spark, sf_dir))


@query("k2_stratified_split", f"WITH d AS (SELECT c_custkey AS scenario, c_mktsegment AS stage, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY {DRAW}) - 1) % 3 AS t FROM customer) SELECT scenario, stage, CASE t WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split FROM d")
def k2(spark, sf_dir):
    return R.stratified_split(customers(spark, sf_dir))


SPLIT = "sp AS (SELECT unnest(range(5)) AS scenario, unnest(['train', 'train', 'train', 'validation', 'test']) AS split)"


def fixed_split(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(["train", "train", "train", "validation", "test"])], "scenario long, split string")


@query("c2_scenario_split_join", f"WITH {LB}, {SPLIT} SELECT scenario, idx, split FROM lb JOIN sp USING (scenario)")
def c2(spark, sf_dir):
    return labelled(spark, sf_dir).join(F.broadcast(fixed_split(spark)), "scenario").select("scenario", "idx", "split")


DOUBLED = "sp AS (SELECT unnest([0, 1, 2, 3, 3]) AS scenario, unnest(['train', 'train', 'validation', 'validation', 'test']) AS split)"


@query("g4_split_audit", f"WITH {LB}, {SAMPLES}, {DOUBLED}, pl AS (SELECT sa.*, split FROM sa LEFT JOIN sp USING (scenario) WHERE len(inputs) = 8 AND target IS NOT NULL), ky AS (SELECT key FROM (SELECT unnest(inputs) AS key, split FROM pl WHERE split IS NOT NULL) GROUP BY key HAVING count(DISTINCT split) > 1) SELECT coalesce(split, 'unassigned') AS split, count(*) AS samples, count(*) FILTER (target) AS positive, (SELECT count(*) FROM (SELECT scenario FROM sp GROUP BY scenario HAVING count(DISTINCT split) > 1)) AS in_two_splits, (SELECT count(*) FROM ky) AS shared_states FROM pl GROUP BY 1")
def g4(spark, sf_dir):
    """An assignment with faults: scenario 3 is in two splits, scenario 4 in none."""
    faulty = spark.createDataFrame([(0, "train"), (1, "train"), (2, "validation"), (3, "validation"), (3, "test")], "scenario long, split string")
    return R.split_audit(R.samples(labelled(spark, sf_dir), 8, 5), faulty)


@query("c1_sample_states", f"WITH {LB}, {SAMPLES} SELECT lb.scenario, lb.idx, round(bytes, 6) AS bytes, target FROM sa JOIN lb ON sa.inputs[8] = lb.scenario || ':' || lb.idx WHERE len(inputs) = 8 AND target IS NOT NULL")
def c1(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    last = R.samples(rows, 8, 5).select(F.element_at("inputs", -1).alias("state_key"), "target")
    return rounded(rows.withColumn("state_key", F.concat_ws(":", "scenario", "idx")).join(last, "state_key").select("scenario", "idx", "bytes", "target"))


FEATURES = ["bytes", "failed_auth", "event_count", "rst_count", "retransmission", "tunnel"]
WEIGHTS = {"bytes": 0.8, "failed_auth": 1.1, "event_count": -0.4, "rst_count": 0.3, "retransmission": 0.6, "tunnel": -0.2}
LONG = "lo AS (" + " UNION ALL ".join(f"SELECT scenario, idx, '{f}' AS feature, coalesce(CAST({f} AS DOUBLE), 0) AS value FROM lb" for f in FEATURES) + "), fs AS (SELECT feature, avg(value) AS mean, CASE WHEN stddev_pop(value) = 0 THEN 1 ELSE stddev_pop(value) END AS scale FROM lo WHERE scenario < 3 GROUP BY feature), ve AS (SELECT scenario, idx, feature, (value - mean) / scale AS z FROM lo JOIN fs USING (feature))"
WT = "wt AS (SELECT unnest(" + str(list(WEIGHTS)) + ") AS feature, unnest([" + ", ".join(f"{v}E0" for v in WEIGHTS.values()) + "]) AS weight)"


def long_form(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    return R.vectors(rows, R.standardise(rows, FEATURES, F.col("scenario") < 3), FEATURES, ["scenario", "idx"])


def weights(spark):
    return spark.createDataFrame(list(WEIGHTS.items()), "feature string, weight double")


@query("b4_vectorise", f"WITH {LB}, {LONG} SELECT scenario, idx, feature, round(z, 6) AS z FROM ve")
def b4(spark, sf_dir):
    return rounded(long_form(spark, sf_dir).select("scenario", "idx", "feature", "z"))


@query("b3_feature_schema", f"WITH {LB}, {LONG} SELECT feature, round(mean, 9) AS mean, round(scale, 6) AS scale FROM fs")
def b3(spark, sf_dir):
    return R.standardise(labelled(spark, sf_dir), [*FEATURES, "infiltration"], F.col("scenario") < 3).select("feature", F.round("mean", 9).alias("mean"), F.round("scale", 6).alias("scale"))


@query("f1_top_drivers", f"WITH {LB}, {LONG}, {WT}, r AS (SELECT scenario, idx, feature, z * weight AS contribution, row_number() OVER (PARTITION BY scenario, idx ORDER BY round(abs(z * weight), 9) DESC, feature) AS rank FROM ve JOIN wt USING (feature)) SELECT scenario, idx, feature, round(contribution, 6) AS contribution, CAST(rank AS INT) AS rank FROM r WHERE rank <= 5")
def f1(spark, sf_dir):
    return rounded(R.top_drivers(long_form(spark, sf_dir), weights(spark), ["scenario", "idx"]))


@query("k41_linear_attribution", f"WITH {LB}, {LONG}, {WT} SELECT scenario, idx, round(sum(z * weight), 6) AS logit, round(max(z * weight), 6) AS greatest_part FROM ve JOIN wt USING (feature) GROUP BY scenario, idx")
def k41(spark, sf_dir):
    parts = long_form(spark, sf_dir).join(F.broadcast(weights(spark)), "feature").withColumn("part", F.col("z") * F.col("weight"))
    return rounded(parts.groupBy("scenario", "idx").agg(F.sum("part").alias("logit"), F.max("part").alias("greatest_part")))


@query("f4_top_weights")
def f4(spark, sf_dir):
    """The heaviest coefficients of the baseline fitted on the tables."""
    from ..operators import learn as M
    from .learn import standard

    model = M.fit_baseline(standard(spark, sf_dir).where("scenario < 3"), FEATURES, constant=True)
    fitted = spark.createDataFrame([(f, float(w)) for f, w in zip(FEATURES, model.coefficients, strict=True)], "feature string, weight double")
    return fitted.orderBy(F.abs("weight").desc(), "feature").limit(3)


DECAY = "tl AS (SELECT scenario, idx, p, horizon, CASE WHEN horizon <= 1 THEN p WHEN p >= 0.5 THEN 0.5E0 + abs(p - 0.5E0) * 0.85E0 ** (horizon - 1) ELSE 0.5E0 - abs(p - 0.5E0) * 0.85E0 ** (horizon - 1) END AS forecast FROM lb, (SELECT unnest(range(1, 6)) AS horizon))"


@query("k5_forecast_timeline", f"WITH {LB}, {DECAY} SELECT scenario, idx, CAST(horizon AS INT) AS horizon, round(forecast, 6) AS forecast FROM tl")
def k5(spark, sf_dir):
    return rounded(R.timeline(labelled(spark, sf_dir), 5).select("scenario", "idx", "horizon", "forecast"))


@query("h6_probability_decay", "WITH s AS (SELECT l_orderkey, l_linenumber, l_discount * 6 + l_tax * 5 AS p FROM lineitem) SELECT l_orderkey, l_linenumber, round(CASE WHEN l_linenumber <= 1 THEN p WHEN p >= 0.5 THEN 0.5E0 + abs(p - 0.5E0) * 0.85E0 ** (l_linenumber - 1) ELSE 0.5E0 - abs(p - 0.5E0) * 0.85E0 ** (l_linenumber - 1) END, 6) AS forecast FROM s")
def h6(spark, sf_dir):
    """Scores of lines decayed by their place in the order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rounded(lines.select("l_orderkey", "l_linenumber", S.decay(F.col("l_discount") * 6 + F.col("l_tax") * 5, F.col("l_linenumber")).alias("forecast")))


@query("k6_flagged_windows", f"WITH {LB}, {DECAY} SELECT scenario, idx, CAST(min(horizon) AS INT) AS lead_windows, count(*) AS flagged FROM tl WHERE forecast >= 0.3 GROUP BY scenario, idx")
def k6(spark, sf_dir):
    return R.timeline(labelled(spark, sf_dir), 5).where("forecast >= 0.3").groupBy("scenario", "idx").agg(F.min("horizon").alias("lead_windows"), F.count("*").alias("flagged"))


@query("b10_stage_from_probability", f"WITH {LB} SELECT scenario, idx, CASE WHEN p >= 0.75 THEN 'Lateral Movement' WHEN p >= 0.5 THEN 'Reconnaissance' WHEN p >= 0.25 THEN 'Benign with Anomaly' ELSE 'Benign' END AS stage FROM lb")
def b10(spark, sf_dir):
    return labelled(spark, sf_dir).select("scenario", "idx", S.stage_from_probability(F.col("p")).alias("stage"))


@query("h13_forecast_confidence", f"WITH {LB} SELECT scenario, idx, round(greatest(0, least(1, sqrt(0.64E0) * (0.5E0 + 0.5E0 * (1 - least(1, abs(p - 0.4E0) / 0.5E0))) * (0.5E0 + 0.5E0 * (2 * abs(p - 0.5E0))))), 6) AS confidence FROM lb")
def h13(spark, sf_dir):
    return rounded(labelled(spark, sf_dir).select("scenario", "idx", S.forecast_confidence(F.col("p"), F.lit(0.4), F.lit(0.64), F.lit(True)).alias("confidence")))


@query("c12_expected_alerts", f"WITH {LB}, ex AS (SELECT DISTINCT scenario, CASE stage WHEN 'Lateral Movement' THEN 'lateral_movement' WHEN 'Exfiltration' THEN 'exfiltration' ELSE 'reconnaissance' END AS t FROM lb WHERE infiltration AND scenario < 4), ob AS (SELECT DISTINCT scenario, 'exfiltration' AS t FROM p WHERE p_exfiltration >= 0.8), e AS (SELECT scenario, list(t ORDER BY t) AS e FROM ex GROUP BY scenario), o AS (SELECT scenario, list(t ORDER BY t) AS o FROM ob GROUP BY scenario), b AS (SELECT scenario, coalesce(e, []) AS e, coalesce(o, []) AS o FROM e FULL JOIN o USING (scenario)) SELECT scenario, array_to_string(list_filter(e, lambda x: list_contains(o, x)), ',') AS hit, array_to_string(list_filter(e, lambda x: NOT list_contains(o, x)), ',') AS missed, array_to_string(list_filter(o, lambda x: NOT list_contains(e, x)), ',') AS unexpected, CASE WHEN len(e) = 0 THEN 'NO-CLAIM' WHEN len(list_filter(e, lambda x: NOT list_contains(o, x))) = 0 THEN 'HIT' ELSE 'MISS' END AS verdict FROM b")
def c12(spark, sf_dir):
    kind = F.when(F.col("stage") == "Lateral Movement", "lateral_movement").when(F.col("stage") == "Exfiltration", "exfiltration").otherwise("reconnaissance")
    expected = labelled(spark, sf_dir).where("infiltration and scenario < 4").select("scenario", kind.alias("attack_type"))
    observed = scored(spark, sf_dir).where("p_exfiltration >= 0.8").select("scenario", F.lit("exfiltration").alias("attack_type"))
    return R.expected_against_observed(expected, observed)
