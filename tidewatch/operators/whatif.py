"""What-if analytics: red-team moves over edges, counterfactuals, attributions, cost frontiers and quantile intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import band
from .detect import ALERT_AT, MIN_HISTORY
from .scores import order_statistic


# Bands of the rules that moves are aimed at, and the size of a probe.
RATE_WARN, RATE_ALERT, VOLUME_ALERT, PROBE_BYTES, PROBE_SHARE, SLACK = 750.0, 900.0, 150_000.0, 200.0, 0.30, 0.95


def red_team_moves(scored: DataFrame, edges: DataFrame, seconds: float) -> DataFrame:
    """Each detector's evasions in each window: (scenario, k, detector, move, evades, tampering, cost_bytes, cost_windows).

    A move is applied to the window's edges and the rule is run again on what is left. Throttling caps each edge, so the
    known-edge rate falls and the rest takes more windows; the volume rule reads the window's total, which a cap on edges
    leaves as it is. Splitting adds hops beside the edges that stay, so the known bytes don't change. A rule that doesn't
    alert has nothing to evade.
    """
    counts = edges.groupBy("scenario", "k").agg(F.count("*").alias("edges"), F.sum("bytes").alias("window_bytes"), F.sum(F.when(F.col("known"), F.col("bytes")).otherwise(0.0)).alias("known_bytes"))
    cap = F.greatest(F.lit(1.0), F.lit(RATE_WARN * SLACK) / F.col("edges")) * seconds
    capped = edges.where("known").join(counts.select("scenario", "k", "edges"), ["scenario", "k"]).groupBy("scenario", "k").agg(F.sum(F.least(F.col("bytes"), cap)).alias("capped_bytes"))
    rows = scored.drop("known_bytes").join(counts, ["scenario", "k"]).join(capped, ["scenario", "k"], "left")
    rate, slowed, history = F.col("known_bytes") / seconds, F.coalesce(F.col("capped_bytes"), F.lit(0.0)) / seconds, F.col("idx") >= MIN_HISTORY
    lateral = lambda r: F.coalesce(F.when(history, band(r, RATE_WARN, RATE_ALERT)), F.lit(0.0)) >= ALERT_AT["lateral_movement"]
    extra = lambda now, most: F.greatest(F.lit(0.0), now / max(1.0, most * SLACK) - 1)
    zero, no = F.lit(0.0), F.lit(False)

    def move(name: str, evades, cost_bytes=zero, cost_windows=zero, tampering: bool = False):
        return F.struct(F.lit(name).alias("move"), evades.alias("evades"), F.lit(tampering).alias("tampering"), cost_bytes.alias("cost_bytes"), cost_windows.alias("cost_windows"))

    share = F.col("probe_share")
    added = F.greatest(F.lit(1).cast("long"), F.floor(F.col("edges") * F.greatest(zero, 1 - F.lit(PROBE_SHARE) / share)))
    own = {
        "lateral_movement": [F.when(rate > RATE_WARN, move("throttle_the_transfer", ~lateral(slowed), cost_windows=extra(rate, RATE_WARN))), move("split_the_transfer_over_more_edges", ~lateral(rate))],
        "exfiltration": [F.when(F.col("window_bytes") > VOLUME_ALERT, move("throttle_the_transfer", no, cost_windows=extra(F.col("window_bytes"), VOLUME_ALERT)))],
        "credential_abuse": [F.when(share > 0, move("dilute_share_with_benign_edges", no, cost_bytes=added * PROBE_BYTES * 0.5))],
    }
    each = []
    for detector, at in ALERT_AT.items():
        fires = lateral(rate) if detector == "lateral_movement" else F.col(f"p_{detector}") >= at
        moves = F.array_compact(F.array(*own.get(detector, []), move("edit_the_flow_exporter", F.lit(True), tampering=True)))
        each.append(F.struct(F.lit(detector).alias("detector"), F.when(fires, moves).otherwise(F.array(move("not_firing", no))).alias("moves")))
    long = rows.select("scenario", "k", F.explode(F.array(*each)).alias("x")).select("scenario", "k", "x.detector", F.explode("x.moves").alias("m"))
    out = long.select("scenario", "k", "detector", "m.*").withColumn("feasible", F.col("evades") & ~F.col("tampering"))
    return out.withColumn("free", F.col("feasible") & (F.col("cost_bytes") == 0) & (F.col("cost_windows") == 0))


def cheapest(moves: DataFrame) -> DataFrame:
    """The feasible move of the fewest windows, then the fewest bytes, against each detector in each window."""
    return moves.where("feasible").groupBy("scenario", "k", "detector").agg(F.min_by("move", F.struct("cost_windows", "cost_bytes", "move")).alias("move"))


def counterfactual(parts: DataFrame, keys: list[str], intercept: float, target: float, most: int = 3) -> DataFrame:
    """How far the parts of a logit must go toward 0 to bring it to target: the ``most`` of the greatest size, those that help, in turn.

    A part with a positive weight goes down as far as is still needed, one with a negative weight goes to 0.
    """
    ranked = F.sort_array(F.collect_list(F.struct(F.round(F.abs("contribution"), 9).alias("size"), "feature", "contribution", "weight")), asc=False)
    rows = parts.groupBy(*keys).agg((F.sum("contribution") + intercept).alias("logit"), F.slice(ranked, 1, most).alias("top"))
    gap = F.col("logit") - target
    step = lambda left, x: F.when((left <= 0) | (x["contribution"] <= 0), left).when(x["weight"] > 0, left - F.least(x["contribution"], left)).otherwise(left - x["contribution"])
    left = F.aggregate("top", gap, step)
    return rows.select(*keys, "logit", gap.alias("needed"), (gap - left).alias("reduced"), (left <= 1e-9).alias("reached"))


def path_gradient(long: DataFrame, keys: list[str], intercept: float, steps: int = 16) -> DataFrame:
    """Integrated gradient of a logistic score from 0 to each row: z x weight x mean slope along the path."""
    total = long.groupBy(*keys).agg(F.sum(F.col("z") * F.col("weight")).alias("logit"))
    slope = lambda a: F.exp(-(F.col("logit") * a + intercept)) / F.pow(1 + F.exp(-(F.col("logit") * a + intercept)), 2)
    mean = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.lit(0.0), lambda s, i: s + slope((i - 0.5) / steps)) / steps
    return long.join(total.withColumn("slope", mean), keys).select(*keys, "feature", (F.col("z") * F.col("weight") * F.col("slope")).alias("attribution"))


def feature_cost(features: DataFrame, tiers: DataFrame, keys: list[str]) -> DataFrame:
    """Cost of feature sets: the greatest tier plus the mean tier of their features."""
    return features.join(tiers, "feature").groupBy(*keys).agg((F.max("tier") + F.avg("tier")).alias("cost"), F.count("*").alias("n"))


def frontier(points: DataFrame, cost: str, score: str, lower_is_better: bool = True) -> DataFrame:
    """Points no cheaper one of which is as good, by a running best in the order of cost."""
    before = Window.orderBy(cost, score if lower_is_better else F.col(score).desc()).rowsBetween(Window.unboundedPreceding, -1)
    best = F.min(score).over(before) if lower_is_better else F.max(score).over(before)
    better = F.col(score) < F.col("best") if lower_is_better else F.col(score) > F.col("best")
    return points.withColumn("best", best).where(F.col("best").isNull() | better).drop("best")


def quantile_bands(rows: DataFrame, coverage: float, bins: int = 10) -> DataFrame:
    """Lower and upper conditional quantiles of the truth in each bin of the score."""
    place = F.least(F.lit(bins - 1), F.floor(F.col("score") * bins))
    y, tail = F.col("truth").cast("double"), (1 - coverage) / 2
    return rows.groupBy(place.alias("bin")).agg(F.percentile(y, tail).alias("low"), F.percentile(y, 1 - tail).alias("high"), F.count("*").alias("n"))


def conformalised_bands(fit: DataFrame, calibration: DataFrame, coverage: float, bins: int = 10) -> DataFrame:
    """quantile_bands of ``fit``, widened (or narrowed) by one tau so that they cover ``coverage`` of ``calibration``; clipped to 0 and 1.

    tau is the covering order statistic of how far each truth falls outside its band, negative inside. A bin without rows
    in ``fit`` has the band from 0 to 1. With too few calibration rows tau and the bands are null.
    """
    place = F.least(F.lit(bins - 1), F.floor(F.col("score") * bins))
    bands = quantile_bands(fit, coverage, bins).drop("n")
    y = F.col("truth").cast("double")
    outside = F.greatest(F.coalesce("low", F.lit(0.0)) - y, y - F.coalesce("high", F.lit(1.0)))
    tau = order_statistic(calibration.withColumn("bin", place).join(bands, "bin", "left"), outside, 1 - coverage).select(F.col("q").alias("tau"))
    low, high = F.col("low") - F.col("tau"), F.col("high") + F.col("tau")
    bounded = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)))
    return bands.join(F.broadcast(tau)).select("bin", bounded(low).alias("low"), bounded(high).alias("high"), "tau")


def permuted(long: DataFrame, reference: DataFrame, keys: list[str], intercept: float, draws: int = 3, pick=None) -> DataFrame:
    """Mean drop of a logistic score when one feature takes the value of another observation, over ``draws`` partners.

    ``long`` has a feature's z and weight by row, ``reference`` (place, feature, other) a population placed from 0 on.
    ``pick`` makes the partner's place from the draw and the population's size; by default a hash of row, feature and draw.
    An empty population gives no rows.
    """
    n = reference.agg(F.max("place")).first()[0]
    size = F.lit(0 if n is None else n + 1)
    pick = pick or (lambda draw, size: F.pmod(F.xxhash64(*keys, "feature", draw), size))
    total = long.groupBy(*keys).agg(F.sum(F.col("z") * F.col("weight")).alias("logit"))
    drawn = long.join(total, keys).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("place", pick(F.col("draw"), size))
    score = lambda logit: 1 / (1 + F.exp(-(logit + intercept)))
    drop = score(F.col("logit")) - score(F.col("logit") + (F.col("other") - F.col("z")) * F.col("weight"))
    return drawn.join(reference, ["feature", "place"]).groupBy(*keys, "feature").agg(F.avg(drop).alias("attribution"))


def parent_technique(technique: Column) -> Column:
    return F.substring_index(technique, ".", 1)


def attack_types(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (technique) with attack_type by the exact technique, else by its parent."""
    exact = table.select(F.col("id").alias("e"), F.col("attack_type").alias("t1"))
    parent = table.select(F.col("id").alias("q"), F.col("attack_type").alias("t2"))
    both = rows.join(exact, F.col("technique") == F.col("e"), "left").join(parent, parent_technique(F.col("technique")) == F.col("q"), "left")
    return both.withColumn("attack_type", F.coalesce("t1", "t2")).drop("e", "q", "t1", "t2")
