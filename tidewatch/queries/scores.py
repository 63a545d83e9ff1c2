"""Metrics, calibration, conformal, bootstrap, drift and survival: D23 to D25, H4, K7 to K9, K12 to K25, K27, K28, K31."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import CENTRE, TAIL, TAIL_FROM, normal_quantile
from ..operators import scores as S
from .windows import rounded

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def scored(spark, sf_dir):
    """Lines as scored rows: score from discount and tax, truth from the return flag, group from the line status."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.round((F.col("l_discount") * 6 + F.col("l_tax") * 5), 2).alias("score"), (F.col("l_returnflag") == "R").alias("truth"), F.col("l_linestatus").alias("grp"),
    )


SC = "sc AS (SELECT l_orderkey * 10 + l_linenumber AS id, round(l_discount * 6 + l_tax * 5, 2) AS score, l_returnflag = 'R' AS truth, l_linestatus AS grp FROM lineitem)"
RATES = "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END, 6) AS f1, round(CASE WHEN fp + tn > 0 THEN fp / (fp + tn) END, 6) AS fpr"
COUNTS = "count(*) FILTER (score >= t AND truth) AS tp, count(*) FILTER (score >= t AND NOT truth) AS fp, count(*) FILTER (score < t AND truth) AS fn, count(*) FILTER (score < t AND NOT truth) AS tn"
CUTS = [round(0.05 * i, 2) for i in range(1, 20)]
GRID = f"gr AS (SELECT t AS threshold, {COUNTS} FROM sc, (SELECT unnest({CUTS}) AS t) GROUP BY t)"
BINS = "bn AS (SELECT least(9, CAST(floor(score * 10) AS BIGINT)) AS b, count(*) AS n, avg(score) AS mean_score, avg(CAST(truth AS DOUBLE)) AS rate FROM sc GROUP BY 1)"


@query("d23_confusion", f"WITH {SC}, c AS (SELECT grp, {COUNTS} FROM sc, (SELECT 0.5E0 AS t) GROUP BY grp) SELECT grp, tp, fp, fn, tn, {RATES} FROM c")
def d23(spark, sf_dir):
    return rounded(S.confusion(scored(spark, sf_dir), F.lit(0.5), ["grp"]))


@query("d24_average_precision", f"WITH {SC}, g AS (SELECT score, count(*) AS n, count(*) FILTER (truth) AS pos FROM sc GROUP BY score), r AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (ORDER BY score DESC)) SELECT round(sum(pos * tp / seen) / sum(pos), 6) AS average_precision FROM r")
def d24(spark, sf_dir):
    return rounded(S.average_precision(scored(spark, sf_dir)))


@query("d25_roc_auc", f"WITH {SC}, g AS (SELECT score, count(*) FILTER (truth) AS pos, count(*) FILTER (NOT truth) AS neg FROM sc GROUP BY score), r AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(CAST(sum(pos * (below + neg / 2)) AS DOUBLE) / CAST(sum(pos) * sum(neg) AS DOUBLE), 6) AS roc_auc FROM r")
def d25(spark, sf_dir):
    return rounded(S.roc_auc(scored(spark, sf_dir)))


@query("k9_threshold_sweep", f"WITH {SC}, {GRID} SELECT threshold, tp, fp, fn, tn, {RATES} FROM gr")
def k9(spark, sf_dir):
    return rounded(S.threshold_grid(scored(spark, sf_dir), CUTS))


@query("k7_calibrated_threshold", f"WITH {SC}, {GRID}, v AS (SELECT threshold, round(2 * tp / (2 * tp + fp + fn), 12) AS f1, round(tp / (tp + fn) - fp / (fp + tn), 12) AS youden FROM gr) SELECT 'f1' AS objective, (SELECT threshold FROM v ORDER BY f1 DESC, threshold LIMIT 1) AS threshold UNION ALL SELECT 'youden', (SELECT threshold FROM v ORDER BY youden DESC, threshold LIMIT 1)")
def k7(spark, sf_dir):
    grid = S.threshold_grid(scored(spark, sf_dir), CUTS)
    one = lambda o: S.calibrated_threshold(grid, o).select(F.lit(o).alias("objective"), "threshold")
    return one("f1").union(one("youden"))


@query("k8_threshold_at_fpr", f"WITH {SC}, g AS (SELECT score, count(*) FILTER (NOT truth) AS neg FROM sc GROUP BY score), r AS (SELECT score, sum(neg) OVER (ORDER BY score DESC) AS above, (SELECT sum(neg) FROM g) AS total FROM g) SELECT min(score) AS threshold FROM r WHERE above <= 0.05E0 * total")
def k8(spark, sf_dir):
    return S.threshold_at_fpr(scored(spark, sf_dir), 0.05)


@query("k27_reliability", f"WITH {SC}, {BINS} SELECT bin, coalesce(n, 0) AS n, round(mean_score, 6) AS mean_score, round(rate, 6) AS rate FROM (SELECT unnest(range(10)) AS bin) LEFT JOIN bn ON bin = b")
def k27(spark, sf_dir):
    return rounded(S.reliability(scored(spark, sf_dir)))


@query("k27_calibration_error", f"WITH {SC}, {BINS} SELECT round(sum(n * abs(mean_score - rate)) / sum(n), 6) AS ece FROM bn")
def k27e(spark, sf_dir):
    return rounded(S.calibration_error(S.reliability(scored(spark, sf_dir))))


@query("k28_brier_parts", f"WITH {SC}, {BINS}, w AS (SELECT avg((score - CAST(truth AS DOUBLE)) ** 2) AS brier, avg(CAST(truth AS DOUBLE)) AS base FROM sc) SELECT round(any_value(brier), 6) AS brier, round(sum(n * (mean_score - rate) ** 2) / sum(n), 6) AS reliability, round(sum(n * (rate - base) ** 2) / sum(n), 6) AS resolution, round(any_value(base * (1 - base)), 6) AS uncertainty, round(1 - any_value(brier) / any_value(base * (1 - base)), 6) AS skill FROM bn, w")
def k28(spark, sf_dir):
    return rounded(S.brier_parts(scored(spark, sf_dir)))


def quantile_sql(group: str) -> str:
    by, part = (f"{group}, ", f"PARTITION BY {group} ") if group else ("", "")
    return f"rs AS (SELECT {by}abs(CAST(truth AS DOUBLE) - score) AS q, row_number() OVER ({part}ORDER BY abs(CAST(truth AS DOUBLE) - score)) AS r, count(*) OVER ({part}) AS n FROM sc), cq AS (SELECT {by}q, n FROM rs WHERE r = CAST(ceil((n + 1) * 0.9E0 - 1e-9) AS BIGINT))"


@query("k23_split_conformal", f"WITH {SC}, {quantile_sql('')} SELECT round(q, 6) AS q, n FROM cq")
def k23(spark, sf_dir):
    return rounded(S.conformal_quantile(scored(spark, sf_dir), 0.1))


@query("k24_group_conformal", f"WITH {SC}, {quantile_sql('grp')} SELECT grp, round(q, 6) AS q, n FROM cq WHERE n >= 8")
def k24(spark, sf_dir):
    return rounded(S.conformal_quantile(scored(spark, sf_dir), 0.1, ["grp"], 8))


@query("k24_pooled_fallback", """WITH sc AS (SELECT l_shipdate AS day, abs(CAST(l_returnflag = 'R' AS DOUBLE) - round(l_discount * 6 + l_tax * 5, 2)) AS x FROM lineitem),
o AS (SELECT day, x, row_number() OVER (PARTITION BY day ORDER BY x) AS r, count(*) OVER (PARTITION BY day) AS n FROM sc), w AS (SELECT day, max(n) AS n, max(CASE WHEN r = CAST(ceil((n + 1) * 0.9E0 - 1e-9) AS BIGINT) AND n >= 8 THEN x END) AS q FROM o GROUP BY day),
a AS (SELECT x, row_number() OVER (ORDER BY x) AS r, count(*) OVER () AS n FROM sc), p AS (SELECT x AS q, n FROM a WHERE r = CAST(ceil((n + 1) * 0.9E0 - 1e-9) AS BIGINT))
SELECT w.day, round(coalesce(w.q, p.q), 6) AS q, CASE WHEN w.q IS NULL THEN p.n ELSE w.n END AS n, CASE WHEN w.q IS NULL THEN 'pooled' ELSE 'own' END AS method FROM w, p""")
def k24_fallback(spark, sf_dir):
    """Groups are days: many have too few rows for a half-width of their own."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_shipdate").alias("day"), F.round(F.col("l_discount") * 6 + F.col("l_tax") * 5, 2).alias("score"), (F.col("l_returnflag") == "R").alias("truth"))
    return rounded(S.calibrated_groups(rows, 0.1, "day"))


@query("k25_coverage", f"WITH {SC}, {quantile_sql('')}, iv AS (SELECT sc.*, greatest(0, score - q) AS low, least(1, score + q) AS high FROM sc, cq), a AS (SELECT grp, count(*) AS n, avg(CAST(CAST(truth AS DOUBLE) BETWEEN low AND high AS DOUBLE)) AS coverage, avg(high - low) AS width, count(*) FILTER (high - low <= 0 OR high - low >= 1) AS degenerate FROM iv GROUP BY grp) SELECT grp, n, round(coverage, 6) AS coverage, round(width, 6) AS width, degenerate, coverage >= 0.9 - 3 * sqrt(0.09E0 / n) AS ok FROM a")
def k25(spark, sf_dir):
    rows = scored(spark, sf_dir)
    q = S.conformal_quantile(rows, 0.1).select("q")
    return rounded(S.coverage(S.intervals(rows.join(q), F.col("q")), 0.9, ["grp"]))


@query("k31_paired_bootstrap")
def k31(spark, sf_dir):
    rows = scored(spark, sf_dir)
    truth = F.col("truth").cast("double")
    return rounded(S.bootstrap(rows, F.pow(F.col("score") - truth, 2), F.pow(F.lit(0.5) - truth, 2), 200))


def feature_rows(spark, sf_dir):
    """Events as drift streams: day and two features."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("day", F.dayofmonth("ts").cast("long"))
    level = F.get_json_object("props", "$.k").cast("double")
    return rows.select("day", "event_id", F.explode(F.array(F.struct(F.lit("value").alias("feature"), F.col("value").alias("value")), F.struct(F.lit("level").alias("feature"), level.alias("value")))).alias("x")).select("day", "event_id", "x.feature", "x.value")


FR = "fr AS (SELECT CAST(day(ts) AS BIGINT) AS day, event_id, 'value' AS feature, value FROM events UNION ALL SELECT CAST(day(ts) AS BIGINT), event_id, 'level', CAST(json_extract_string(props, '$.k') AS DOUBLE) FROM events)"
PSI_BASE = f"""{FR}, rf AS (SELECT * FROM fr WHERE day <= 10), rk AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY feature) AS n FROM rf),
pk AS (SELECT feature, i, greatest(0, CAST(round_even(i * n / 10.0E0, 0) AS BIGINT) - 1) AS spot FROM (SELECT DISTINCT feature, n FROM rk), (SELECT unnest(range(1, 10)) AS i)),
ed AS (SELECT pk.feature, list(value ORDER BY value) AS edges FROM pk JOIN rk ON pk.feature = rk.feature AND r = spot GROUP BY pk.feature),
pl AS (SELECT fr.feature, day, len(list_filter(edges, lambda e: e < value)) AS bin FROM fr JOIN ed USING (feature)),
rs AS (SELECT feature, bin, count(*) / sum(count(*)) OVER (PARTITION BY feature) AS r FROM pl WHERE day <= 10 GROUP BY feature, bin)"""


def blocks_sql(name: str, key: str, source: str = "pl") -> str:
    """CTE ``name`` (feature, day, psi) of the blocks named by ``key`` over the days after the tenth."""
    return f"""n_{name} AS (SELECT feature, {key} AS day, bin, count(*) / sum(count(*)) OVER (PARTITION BY feature, {key}) AS p FROM {source} WHERE day > 10 GROUP BY feature, {key}, bin),
g_{name} AS (SELECT feature, day, unnest(range(10)) AS bin FROM (SELECT DISTINCT feature, day FROM n_{name})),
{name} AS (SELECT feature, day, round_even(sum((c - r) * ln(c / r)), 6) AS psi FROM (SELECT g.feature, g.day, greatest(coalesce(p, 0), 1e-6) AS c, greatest(coalesce(r, 0), 1e-6) AS r FROM g_{name} AS g LEFT JOIN n_{name} USING (feature, day, bin) LEFT JOIN rs USING (feature, bin)) GROUP BY feature, day)"""


def monitor_sql(blocks: str, name: str, null: str) -> str:
    """CTE ``name`` (day, feature, psi, trip, exceeds) of the blocks that aren't ``null`` against those that are."""
    return f"""w_{name} AS (SELECT day, max(psi) AS w FROM {blocks} WHERE {null} GROUP BY day), t_{name} AS (SELECT quantile_cont(w, 0.9) AS trip FROM w_{name}),
m_{name} AS (SELECT day, max(psi) AS psi, arg_max(feature, (psi, feature)) AS feature FROM {blocks} WHERE NOT ({null}) GROUP BY day), {name} AS (SELECT day, feature, psi, round(trip, 6) AS trip, psi > trip AS exceeds FROM m_{name}, t_{name})"""


PSI = f"{PSI_BASE}, {blocks_sql('ps', 'day')}"


def psi_rows(spark, sf_dir):
    rows = feature_rows(spark, sf_dir)
    reference = rows.where("day <= 10")
    return S.psi(S.psi_edges(reference), reference, rows.where("day > 10"), ["day"])


@query("k16_psi", f"WITH {PSI} SELECT feature, day, psi FROM ps")
def k16(spark, sf_dir):
    return psi_rows(spark, sf_dir)


BAND = """bd AS (SELECT feature, psi AS "limit" FROM (SELECT feature, psi, row_number() OVER (PARTITION BY feature ORDER BY psi) - 1 AS r, count(*) OVER (PARTITION BY feature) AS n FROM ps WHERE day <= 20) WHERE r = CAST(round_even(0.9E0 * (n - 1), 0) AS BIGINT)),
pc AS (SELECT a.feature, a.day, a.psi, round(100 * avg(CAST(b.psi <= a.psi AS DOUBLE)), 1) AS percentile FROM ps AS a JOIN ps AS b ON a.feature = b.feature AND a.day > 20 AND b.day <= 20 GROUP BY a.feature, a.day, a.psi)"""


@query("k17_null_bands", f"WITH {PSI}, {BAND} SELECT feature, day, psi, percentile, \"limit\", CASE WHEN psi > \"limit\" THEN 'exceeds_null' ELSE 'within_null' END AS band FROM pc JOIN bd USING (feature)")
def k17(spark, sf_dir):
    rows = psi_rows(spark, sf_dir)
    return S.banded(rows.where("day > 20"), rows.where("day <= 20"), ["day"], 0.9)


MON = monitor_sql("ps", "mv", "day <= 20")


def monitored(spark, sf_dir):
    rows = psi_rows(spark, sf_dir)
    return rounded(S.monitor(rows.where("day > 20"), rows.where("day <= 20"), ["day"], 0.9))


@query("k18_drift_monitor", f"WITH {PSI}, {MON} SELECT * FROM mv")
def k18(spark, sf_dir):
    return monitored(spark, sf_dir)


@query("k19_detection_delay", f"WITH {PSI}, {MON} SELECT min(CASE WHEN exceeds AND day >= 25 THEN day - 25 END) AS delay, count(*) FILTER (exceeds AND day < 25) AS false_alarms, count(*) AS windows, arg_min(feature, day) FILTER (exceeds AND day >= 25) AS feature FROM mv")
def k19(spark, sf_dir):
    late = F.col("exceeds") & (F.col("day") >= 25)
    return monitored(spark, sf_dir).agg(F.min(F.when(late, F.col("day") - 25)).alias("delay"), F.count_if(F.col("exceeds") & (F.col("day") < 25)).alias("false_alarms"), F.count("*").alias("windows"), F.min_by("feature", F.when(late, F.col("day"))).alias("feature"))


@query("k20_fixed_threshold_rates", f"WITH {PSI}, th AS (SELECT unnest([0.05E0, 0.1E0, 0.25E0]) AS threshold), mx AS (SELECT day, max(psi) AS w FROM ps GROUP BY day), a AS (SELECT threshold, avg(CAST(w > threshold AS DOUBLE)) AS rate FROM mx, th GROUP BY threshold), s AS (SELECT threshold, feature, avg(CAST(psi > threshold AS DOUBLE)) AS own FROM ps, th GROUP BY threshold, feature), m AS (SELECT threshold, median(own) AS median_single_feature FROM s GROUP BY threshold) SELECT threshold, round(rate, 6) AS rate, round(median_single_feature, 6) AS median_single_feature FROM a JOIN m USING (threshold)")
def k20(spark, sf_dir):
    return rounded(S.alarm_rates(psi_rows(spark, sf_dir), ["day"], [0.05, 0.1, 0.25]))


ROLLED = "lt AS (SELECT max(day) AS top FROM fr), ro AS (SELECT feature, day AS d0, bin, unnest([day, day + 1, day + 2]) AS day FROM pl WHERE day > 10), rw AS (SELECT ro.* FROM ro, lt WHERE day BETWEEN 13 AND top)"


@query("e13_rolling_blocks", f"WITH {PSI_BASE}, {ROLLED}, {blocks_sql('rb', 'day', 'rw')}, {monitor_sql('rb', 'mv', 'day <= 20')} SELECT * FROM mv")
def e13(spark, sf_dir):
    """Verdicts over rolling blocks of three days; the first two days have none."""
    rows = feature_rows(spark, sf_dir)
    reference = rows.where("day <= 10")
    blocks = S.rolling_psi(S.psi_edges(reference), reference, rows.where("day > 10"), 3)
    return rounded(S.monitor(blocks.where("day > 20"), blocks.where("day <= 20"), ["day"], 0.9))


def durations(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_shipdate", "l_returnflag")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderdate", "o_orderpriority")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.abs(F.date_diff(F.to_date("l_shipdate"), F.to_date("o_orderdate")) % 180).cast("long").alias("duration"), (F.col("l_returnflag") == "R").alias("event"), F.col("o_orderpriority").alias("grp"))


DU = "du AS (SELECT abs(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) % 180) AS duration, l_returnflag = 'R' AS event, o_orderpriority AS grp FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
KM = f"""{DU}, ct AS (SELECT grp, duration, count(*) AS n, count(*) FILTER (event) AS d FROM du GROUP BY ALL), ar AS (SELECT *, sum(n) OVER (PARTITION BY grp ORDER BY duration DESC) AS at_risk FROM ct),
ev AS (SELECT * FROM ar WHERE d > 0), sv AS (SELECT grp, duration AS time, CAST(at_risk AS BIGINT) AS at_risk, d AS events, CASE WHEN max(CASE WHEN d >= at_risk THEN 1 ELSE 0 END) OVER w = 1 THEN 0 ELSE exp(sum(CASE WHEN d < at_risk THEN ln(1 - d / at_risk) ELSE 0 END) OVER w) END AS survival,
 sum(CASE WHEN d < at_risk THEN d / (at_risk * (at_risk - d)) ELSE 0 END) OVER w AS green FROM ev WINDOW w AS (PARTITION BY grp ORDER BY duration))"""


@query("k12_kaplan_meier", f"WITH {KM} SELECT grp, time, at_risk, events, round(survival, 6) AS survival, round(survival * survival * green, 9) AS variance FROM sv")
def k12(spark, sf_dir):
    return rounded(S.kaplan_meier(durations(spark, sf_dir)), ("variance",)).withColumn("variance", F.round("variance", 9))


MS = "bd AS (SELECT *, CASE WHEN survival > 0 AND survival < 1 THEN 1.959964E0 * sqrt(survival * survival * green) / (survival * abs(ln(survival))) END AS sp FROM sv), bb AS (SELECT grp, time, events, survival, CASE WHEN sp IS NULL THEN survival ELSE survival ** exp(sp) END AS lo, CASE WHEN sp IS NULL THEN survival ELSE survival ** exp(-sp) END AS hi FROM bd)"


@query("k13_median_survival", f"WITH {KM}, {MS} SELECT grp, min(CASE WHEN survival <= 0.5 THEN time END) AS median, min(CASE WHEN lo <= 0.5 THEN time END) AS median_low, min(CASE WHEN hi <= 0.5 THEN time END) AS median_high, sum(events) >= 5 AS usable FROM bb GROUP BY grp")
def k13(spark, sf_dir):
    return S.median_survival(S.kaplan_meier(durations(spark, sf_dir)))


# the rational approximation of the complementary error function, constant term first
ERFC = "t * exp(-x * x + " + " + t * (".join(str(c) + "E0" for c in (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)) + ")" * 10


@query("k14_log_rank", f"WITH {DU}, c AS (SELECT duration, count(*) AS n, count(*) FILTER (grp = '1-URGENT') AS na, count(*) FILTER (event) AS d, count(*) FILTER (event AND grp = '1-URGENT') AS da FROM du WHERE grp IN ('1-URGENT', '5-LOW') GROUP BY duration), s AS (SELECT d, da, CAST(sum(n) OVER w AS DOUBLE) AS r, CAST(sum(na) OVER w AS DOUBLE) AS ra FROM c WINDOW w AS (ORDER BY duration DESC)), e AS (SELECT CAST(sum(da) AS BIGINT) AS observed, sum(d * ra / r) AS expected, sum(CASE WHEN r > 1 THEN d * ra / r * (1 - ra / r) * (r - d) / (r - 1) ELSE 0 END) AS variance FROM s WHERE d > 0), z AS (SELECT observed, expected, (observed - expected) ** 2 / variance AS chi FROM e), x AS (SELECT *, sqrt(chi / 2) AS x, 1 / (1 + 0.5E0 * sqrt(chi / 2)) AS t FROM z) SELECT observed, round(expected, 6) AS expected, round(chi, 6) AS chi_square, round({ERFC}, 6) AS p_value FROM x")
def k14(spark, sf_dir):
    return rounded(S.log_rank(durations(spark, sf_dir), "1-URGENT", "5-LOW"))


@query("k15_survival_table", f"WITH {KM}, {MS}, md AS (SELECT grp, min(CASE WHEN survival <= 0.5 THEN time END) AS median, min(CASE WHEN lo <= 0.5 THEN time END) AS low, min(CASE WHEN hi <= 0.5 THEN time END) AS high, sum(events) >= 5 AS usable FROM bb GROUP BY grp) SELECT grp, count(*) AS n, count(*) FILTER (event) AS events, count(*) FILTER (NOT event) AS censored, round(avg(event::INT), 6) AS detected_fraction, median(CASE WHEN event THEN duration END) AS naive_median, max(md.median) AS median, max(CASE WHEN md.median IS NOT NULL THEN low END) AS median_low, max(CASE WHEN md.median IS NOT NULL THEN high END) AS median_high, coalesce(bool_or(usable), false) AS usable FROM du LEFT JOIN md USING (grp) GROUP BY grp")
def k15(spark, sf_dir):
    return rounded(S.survival_table(durations(spark, sf_dir)))


def _horner(coefficients, x):
    out = f"({coefficients[0]!r}::DOUBLE)"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c!r}::DOUBLE))"
    return out


@query("h5_normal_quantile", f"WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice / (l_extendedprice + 1000 * l_quantity) AS p FROM lineitem), x AS (SELECT *, sqrt(-2 * ln(least(p, 1 - p))) AS q, p - 0.5E0 AS c FROM p), y AS (SELECT *, {_horner(TAIL[0], 'q')} / {_horner(TAIL[1], 'q')} AS tail, {_horner(CENTRE[0], '(c * c)')} * c / {_horner(CENTRE[1], '(c * c)')} AS centre FROM x) SELECT l_orderkey, l_linenumber, round(CASE WHEN p < {TAIL_FROM} THEN tail WHEN p > 1 - {TAIL_FROM} THEN -tail ELSE centre END, 6) AS z FROM y")
def h5(spark, sf_dir):
    """Normal quantiles of a share of each line."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    share = F.col("l_extendedprice") / (F.col("l_extendedprice") + 1000 * F.col("l_quantity"))
    return lines.select("l_orderkey", "l_linenumber", F.round(normal_quantile(share), 6).alias("z"))
