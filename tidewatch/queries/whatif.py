"""What-if analytics: C10, C11, F6, J9, K21, K22, K26, K33, K42, K43."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..events import EVENTS_SQL, SECONDS, events
from ..operators import scores as S
from ..operators import whatif as X
from ..operators.detect import ALERT_AT
from ..plans.tables import stored
from .detect import SCORED, band_sql, known_edges
from .detect import scored as probabilities
from .replay import LB, LONG, WT, long_form, weights
from .scores import FR, PSI_BASE, SC, blocks_sql, feature_rows, monitor_sql, scored
from .windows import rounded

QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


#: The tables' values as transfers of so many bytes each, so that rates meet the rules' bands.
UNIT = 1_000_000.0


def fires_sql(detector: str, at: float) -> str:
    return "is_lateral" if detector == "lateral_movement" else f"p_{detector} >= {at}E0"


def move_sql(detector: str, at: float, name: str, when: str = "true", evades: str = "false", cost_bytes: str = "0", cost_windows: str = "0", tampering: bool = False) -> str:
    return f"SELECT scenario, k, '{detector}' AS detector, '{name}' AS move, {evades} AS evades, {str(tampering).lower()} AS tampering, CAST({cost_bytes} AS DOUBLE) AS cost_bytes, CAST({cost_windows} AS DOUBLE) AS cost_windows FROM r WHERE {fires_sql(detector, at)} AND {when}"


def moves_sql() -> str:
    parts = []
    for d, at in ALERT_AT.items():
        parts += [move_sql(d, at, "edit_the_flow_exporter", evades="true", tampering=True), f"SELECT scenario, k, '{d}', 'not_firing', false, false, 0.0E0, 0.0E0 FROM r WHERE NOT ({fires_sql(d, at)})"]
    d = "lateral_movement"
    parts += [move_sql(d, 0, "throttle_the_transfer", f"rate > {X.RATE_WARN}E0", "NOT slow_lateral", cost_windows=f"greatest(0, rate / {X.RATE_WARN * X.SLACK}E0 - 1)"), move_sql(d, 0, "split_the_transfer_over_more_edges")]
    parts.append(move_sql("exfiltration", ALERT_AT["exfiltration"], "throttle_the_transfer", f"window_bytes > {X.VOLUME_ALERT}E0", cost_windows=f"greatest(0, window_bytes / {X.VOLUME_ALERT * X.SLACK}E0 - 1)"))
    parts.append(move_sql("credential_abuse", ALERT_AT["credential_abuse"], "dilute_share_with_benign_edges", "probe_share > 0", cost_bytes="greatest(1, floor(edges * greatest(0, 1 - 0.3E0 / probe_share))) * 100"))
    return " UNION ALL ".join(parts)


MOVES = f"""ct AS (SELECT scenario, k, count(*) AS edges, sum(bytes * {UNIT}) AS window_bytes, sum(CASE WHEN known THEN bytes * {UNIT} ELSE 0 END) AS known_bytes FROM ek GROUP BY scenario, k),
cp AS (SELECT scenario, k, sum(least(bytes * {UNIT}, greatest(1, {X.RATE_WARN * X.SLACK}E0 / edges) * 21600.0E0)) AS capped FROM ek JOIN ct USING (scenario, k) WHERE known GROUP BY scenario, k),
ra AS (SELECT p.* EXCLUDE (rate), edges, window_bytes, known_bytes / 21600.0E0 AS rate, coalesce(capped, 0) / 21600.0E0 AS slow FROM p JOIN ct USING (scenario, k) LEFT JOIN cp USING (scenario, k)),
r AS (SELECT *, idx >= 3 AND {band_sql('rate', 750.0, 900.0)} >= 0.7E0 AS is_lateral, idx >= 3 AND {band_sql('slow', 750.0, 900.0)} >= 0.7E0 AS slow_lateral FROM ra),
mo AS ({moves_sql()}),
mv AS (SELECT *, evades AND NOT tampering AS feasible, evades AND NOT tampering AND cost_bytes = 0 AND cost_windows = 0 AS free FROM mo)"""


def moves(spark, sf_dir):
    edges = known_edges(spark, sf_dir).withColumn("bytes", F.col("bytes") * UNIT)
    return X.red_team_moves(probabilities(spark, sf_dir), edges, SECONDS)


@query("j9_red_team_moves", f"WITH {SCORED}, {MOVES} SELECT scenario, k, detector, move, evades, tampering, round(cost_bytes, 6) AS cost_bytes, round(cost_windows, 6) AS cost_windows, feasible, free FROM mv")
def j9(spark, sf_dir):
    return rounded(moves(spark, sf_dir))


@query("f6_cheapest_move", f"WITH {SCORED}, {MOVES} SELECT scenario, k, detector, arg_min(move, (cost_windows, cost_bytes, move)) AS move FROM mv WHERE feasible GROUP BY scenario, k, detector")
def f6(spark, sf_dir):
    return X.cheapest(moves(spark, sf_dir))


GAP_LEFT = "CASE WHEN {0} <= 0 OR coalesce({1}, 0) <= 0 THEN {0} WHEN {2} > 0 THEN {0} - least({1}, {0}) ELSE {0} - {1} END"


@query("k43_counterfactual", f"""WITH {LB}, {LONG}, {WT}, c AS (SELECT scenario, idx, weight, z * weight AS p, row_number() OVER (PARTITION BY scenario, idx ORDER BY round(abs(z * weight), 9) DESC, feature DESC) AS r FROM ve JOIN wt USING (feature)),
g AS (SELECT scenario, idx, sum(p) - 1 AS logit, {', '.join(f'max(CASE WHEN r = {i} THEN p END) AS p{i}, max(CASE WHEN r = {i} THEN weight END) AS w{i}' for i in (1, 2, 3))} FROM c GROUP BY ALL),
a AS (SELECT *, logit + 1.5E0 AS gap FROM g), b AS (SELECT *, {GAP_LEFT.format('gap', 'p1', 'w1')} AS l1 FROM a), d AS (SELECT *, {GAP_LEFT.format('l1', 'p2', 'w2')} AS l2 FROM b), e AS (SELECT *, {GAP_LEFT.format('l2', 'p3', 'w3')} AS l3 FROM d)
SELECT scenario, idx, round(logit, 6) AS logit, round(gap, 6) AS needed, round(gap - l3, 6) AS reduced, l3 <= 1e-9 AS reached FROM e""")
def k43(spark, sf_dir):
    parts = long_form(spark, sf_dir).join(weights(spark), "feature").withColumn("contribution", F.col("z") * F.col("weight"))
    return rounded(X.counterfactual(parts, ["scenario", "idx"], -1.0, -1.5))


@query("k42_path_gradient", f"""WITH {LB}, {LONG}, {WT}, g AS (SELECT scenario, idx, sum(z * weight) AS logit FROM ve JOIN wt USING (feature) GROUP BY scenario, idx),
u AS (SELECT scenario, idx, -(logit * (i - 0.5E0) / 16 - 1) AS x FROM g, (SELECT unnest(range(1, 17)) AS i)), m AS (SELECT scenario, idx, avg(exp(x) / (1 + exp(x)) ** 2) AS slope FROM u GROUP BY scenario, idx)
SELECT scenario, idx, feature, round(z * weight * slope, 6) AS attribution FROM ve JOIN wt USING (feature) JOIN m USING (scenario, idx)""")
def k42(spark, sf_dir):
    return rounded(X.path_gradient(long_form(spark, sf_dir).join(weights(spark), "feature"), ["scenario", "idx"], -1.0))


@query("k42_permutation", f"""WITH {LB}, {LONG}, {WT}, g AS (SELECT scenario, idx, sum(z * weight) AS logit FROM ve JOIN wt USING (feature) GROUP BY scenario, idx),
ref AS (SELECT idx AS place, feature, z AS other FROM ve WHERE scenario = 0), sz AS (SELECT max(place) + 1 AS size FROM ref),
dr AS (SELECT scenario, idx, feature, z, weight, logit, (idx * 7 + scenario * 3 + length(feature) * 5 + draw * 11) % size AS place FROM ve JOIN wt USING (feature) JOIN g USING (scenario, idx), sz, (SELECT unnest(range(3)) AS draw))
SELECT scenario, idx, feature, round(avg(1 / (1 + exp(-(logit - 1))) - 1 / (1 + exp(-(logit + (other - z) * weight - 1)))), 6) AS attribution FROM dr JOIN ref USING (feature, place) GROUP BY ALL""")
def k42_permutation(spark, sf_dir):
    """Scenario 0 is the population; partners come from arithmetic that SQL has too."""
    long = stored(long_form(spark, sf_dir), "vectors")
    reference = long.where("scenario = 0").select(F.col("idx").alias("place"), "feature", F.col("z").alias("other"))
    pick = lambda draw, size: (F.col("idx") * 7 + F.col("scenario") * 3 + F.length("feature") * 5 + draw * 11) % size
    return rounded(X.permuted(long.join(weights(spark), "feature"), reference, ["scenario", "idx"], -1.0, pick=pick))


TIERS = [("l_quantity", 1), ("l_extendedprice", 2), ("l_discount", 3), ("l_tax", 5)]


@query("k33_cost_frontier", "WITH t AS (SELECT unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest([1, 2, 3, 5]) AS tier), s AS (SELECT l_linenumber AS subset, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) AS feature, unnest(range(4)) AS i, avg(l_tax) AS score FROM lineitem GROUP BY l_linenumber), c AS (SELECT subset, max(tier) + avg(tier) AS cost, count(*) AS n, round(any_value(score), 9) AS score FROM s JOIN t USING (feature) WHERE i <= subset % 4 GROUP BY subset), b AS (SELECT *, min(score) OVER (ORDER BY cost, score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM c) SELECT subset, round(cost, 6) AS cost, n, score FROM b WHERE best IS NULL OR score < best")
def k33(spark, sf_dir):
    tiers = spark.createDataFrame(TIERS, "feature string, tier int")
    subsets = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy(F.col("l_linenumber").alias("subset")).agg(F.round(F.avg("l_tax"), 9).alias("score"))
    parts = subsets.select("subset", "score", F.posexplode(F.array(*[F.lit(t[0]) for t in TIERS])).alias("i", "feature")).where(F.col("i") <= F.col("subset") % 4)
    cost = X.feature_cost(parts, tiers, ["subset", "score"])
    return X.frontier(cost, "cost", "score").select("subset", F.round("cost", 6).alias("cost"), "n", "score")


@query("k26_quantile_intervals", f"WITH {SC} SELECT least(9, CAST(floor(score * 10) AS BIGINT)) AS bin, round(quantile_cont(CAST(truth AS DOUBLE), 0.05), 6) AS low, round(quantile_cont(CAST(truth AS DOUBLE), 0.95), 6) AS high, count(*) AS n FROM sc GROUP BY 1")
def k26(spark, sf_dir):
    return rounded(X.quantile_bands(scored(spark, sf_dir), 0.9))


SIZED = "sq AS (SELECT l_linenumber AS line, least(9, CAST(floor(round(l_discount * 6 + l_tax * 5, 2) * 10) AS BIGINT)) AS bin, l_quantity / 50 AS y FROM lineitem)"


@query("k26_conformalised_bands", f"""WITH {SIZED}, b AS (SELECT bin, quantile_cont(y, 0.05) AS low, quantile_cont(y, 0.95) AS high FROM sq WHERE line % 2 = 1 GROUP BY bin),
o AS (SELECT greatest(coalesce(low, 0) - y, y - coalesce(high, 1)) AS x FROM sq LEFT JOIN b USING (bin) WHERE line % 2 = 0), r AS (SELECT x, row_number() OVER (ORDER BY x) AS r, count(*) OVER () AS n FROM o),
t AS (SELECT x AS tau FROM r WHERE r = CAST(ceil((n + 1) * 0.9E0 - 1e-9) AS BIGINT))
SELECT bin, round(greatest(0, least(1, low - tau)), 6) AS low, round(greatest(0, least(1, high + tau)), 6) AS high, round(tau, 6) AS tau FROM b, t""")
def k26_conformalised(spark, sf_dir):
    """Bands of the quantity, fitted on lines of odd numbers and widened on the others."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_linenumber", F.round(F.col("l_discount") * 6 + F.col("l_tax") * 5, 2).alias("score"), (F.col("l_quantity") / 50).alias("truth"))
    return rounded(X.conformalised_bands(rows.where("l_linenumber % 2 = 1"), rows.where("l_linenumber % 2 = 0"), 0.9))


@query("c10_technique_types", f"WITH {EVENTS_SQL}, t AS (SELECT event_id, CASE level % 3 WHEN 0 THEN 'T1566.001' WHEN 1 THEN 'T1046' ELSE 'T9999.2' END AS technique FROM ev) SELECT event_id, technique, CASE WHEN technique LIKE 'T1566%' THEN 'phishing' WHEN technique = 'T1046' THEN 'reconnaissance' END AS attack_type FROM t")
def c10(spark, sf_dir):
    table = spark.createDataFrame([("T1566", "phishing"), ("T1046", "reconnaissance")], "id string, attack_type string")
    name = F.when(F.col("level") % 3 == 0, "T1566.001").when(F.col("level") % 3 == 1, "T1046").otherwise("T9999.2")
    return X.attack_types(events(spark, sf_dir).select("event_id", name.alias("technique")), table)


@query("c11_common_features", f"WITH {FR}, a AS (SELECT feature, avg(value) AS reference FROM fr WHERE day <= 10 GROUP BY feature), b AS (SELECT feature, avg(value) AS live FROM fr WHERE day > 20 GROUP BY feature) SELECT feature, round(reference, 9) AS reference, round(live, 9) AS live FROM a JOIN b USING (feature)")
def c11(spark, sf_dir):
    rows = feature_rows(spark, sf_dir)
    reference = rows.where("day <= 10").groupBy("feature").agg(F.round(F.avg("value"), 9).alias("reference"))
    return reference.join(rows.where("day > 20").groupBy("feature").agg(F.round(F.avg("value"), 9).alias("live")), "feature")


@query("k22_snapshot_comparison", f"WITH {PSI_BASE}, {blocks_sql('ps', 'day * 0')}, c AS (SELECT feature, count(*) FILTER (day <= 10) AS reference_count, count(*) FILTER (day > 10) AS current_count FROM fr GROUP BY feature) SELECT feature, psi, reference_count, current_count FROM ps JOIN c USING (feature)")
def k22(spark, sf_dir):
    """The reference period's values captured as a snapshot table, read again and compared with the live ones."""
    rows = feature_rows(spark, sf_dir)
    snapshot = stored(rows.where("day <= 10").select("feature", "value"), "snapshot")
    return S.compare_snapshot(snapshot, rows.where("day > 10").select("feature", "value"))


def sweep_sql(days: int) -> str:
    return f"{blocks_sql(f'b{days}', f'(day - 11) // {days}')}, {monitor_sql(f'b{days}', f'v{days}', f'day * {days} < 10')}"


@query("k21_block_sweep", f"WITH {PSI_BASE}, {', '.join(sweep_sql(d) for d in (1, 2, 5))} " + " UNION ALL ".join(f"SELECT count(*) AS blocks, count(*) FILTER (exceeds) AS exceeding, min(CASE WHEN exceeds THEN day END) AS first, {d} AS days FROM v{d}" for d in (1, 2, 5)))
def k21(spark, sf_dir):
    """False alarms and delay of the drift monitor for blocks of 1, 2 and 5 days."""
    rows = feature_rows(spark, sf_dir)
    reference, out = rows.where("day <= 10"), None
    edges = stored(S.psi_edges(reference), "edges")
    for days in (1, 2, 5):
        blocks = S.psi(edges, reference, rows.where("day > 10").withColumn("block", F.floor((F.col("day") - 11) / days)), ["block"])
        seen = S.monitor(blocks.where(F.col("block") * days >= 10), blocks.where(F.col("block") * days < 10), ["block"], 0.9)
        part = seen.agg(F.count("*").alias("blocks"), F.count_if("exceeds").alias("exceeding"), F.min(F.when(F.col("exceeds"), F.col("block"))).alias("first")).withColumn("days", F.lit(days))
        out = part if out is None else out.union(part)
    return out
