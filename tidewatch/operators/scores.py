"""Metrics of scored rows, thresholds, calibration, conformal intervals, bootstrap and drift.

Rows hold a score in [0, 1], a boolean truth and sometimes a group. Ranks and running sums run over distinct score
values after grouping, which bounds what a frame holds by the number of distinct scores, not of rows.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import erfc

# Cumulative Poisson(1) probabilities.
POISSON = np.array([0.367879441, 0.735758882, 0.919698603, 0.981011843, 0.996340153, 0.999405815, 0.999916759])


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.when(b > 0, a / b)


def confusion(rows: DataFrame, threshold: Column, group: list[str] | None = None) -> DataFrame:
    """Counts and precision, recall, F1 and false-positive rate at a threshold; undefined ones are null."""
    hit, yes = F.col("score") >= threshold, F.col("truth")
    out = rows.groupBy(*(group or [])).agg(F.count_if(hit & yes).alias("tp"), F.count_if(hit & ~yes).alias("fp"), F.count_if(~hit & yes).alias("fn"), F.count_if(~hit & ~yes).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "fpr": ratio(fp, fp + tn)})


def by_score(rows: DataFrame, group: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(group or []), "score").agg(F.count("*").alias("n"), F.count_if("truth").alias("pos"))


BUCKET_ROWS, MOST_BUCKETS = 2_000_000, 8192


def below(cuts: list, value: Column) -> Column:
    """How many of the sorted cuts are below a value: a search over nested halves, so a thousand cuts take ten comparisons."""

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.lit(cuts[middle]) < value, search(middle + 1, high)).otherwise(search(low, middle))

    if len(cuts) <= 256:
        return search(0, len(cuts))
    step = -(-len(cuts) // 256)  # too many for one expression: first the stretch, then the place in it
    stretches = F.array(*[F.array(*[F.lit(c) for c in cuts[i : i + step]]) for i in range(0, len(cuts), step)])
    at = search_stretch(cuts[step - 1 :: step], value)
    inside = F.size(F.filter(F.get(stretches, at), lambda c: c < value))
    return at * step + F.coalesce(inside, F.lit(0))


def search_stretch(ends: list, value: Column) -> Column:
    return below(ends[:255], value) if len(ends) <= 256 else below(ends, value)


def running(rows: DataFrame, value: str, sums: list[str], group: list[str] | None = None, descending: bool = False) -> DataFrame:
    """rows with <name>_before for each of ``sums``: its sum over the rows of the group that come before in the order of value.

    Approximate quantiles of the values cut the rows into buckets of about BUCKET_ROWS rows (MOST_BUCKETS at most, four a
    shuffle partition at least); each is summed by itself and the bucket totals give the offsets, so no task holds a whole
    group. Rows of equal value have any order. The rows are read three times, so they should be stored or cheap.
    """
    group = group or []
    count = rows.count()
    n = max(2, min(MOST_BUCKETS, max(-(-count // BUCKET_ROWS), min(256, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), count))))
    cuts = sorted(set(rows.agg(F.percentile_approx(value, F.array(*[F.lit((i + 1) / n) for i in range(n - 1)])).alias("c")).first()["c"] or []))
    place = below(cuts, F.col(value))
    placed = rows.withColumn("__place", place)
    order = lambda c: F.col(c).desc() if descending else F.col(c).asc()
    totals = placed.groupBy(*group, "__place").agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy(order("__place")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(g).alias(f"__g_{g}") for g in group], F.col("__place").alias("__at"), *[F.coalesce(F.sum(f"__t_{s}").over(before), F.lit(0)).alias(f"__o_{s}") for s in sums])
    on = F.col("__place") == F.col("__at")
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    inside = Window.partitionBy(*group, "__place").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"__i_{s}") for s in sums]).join(offsets, on)
    return out.select(*rows.columns, *[(F.col(f"__o_{s}") + F.col(f"__i_{s}")).alias(f"{s}_before") for s in sums])


def average_precision(rows: DataFrame) -> DataFrame:
    """Step-wise area under precision and recall; null with one class."""
    steps = running(by_score(rows), "score", ["pos", "n"], descending=True)
    steps = steps.select("pos", "n", (F.col("pos_before") + F.col("pos")).alias("tp"), (F.col("n_before") + F.col("n")).alias("seen"))
    return steps.agg(F.when((F.sum("pos") > 0) & (F.sum("pos") < F.sum("n")), F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / F.sum("pos")).alias("average_precision"))


def roc_auc(rows: DataFrame, group: list[str] | None = None) -> DataFrame:
    """Share of positive-negative pairs in the right order, ties by half, of each group; null with one class."""
    steps = running(by_score(rows, group).withColumn("neg", F.col("n") - F.col("pos")), "score", ["neg"], group)
    return steps.groupBy(*(group or [])).agg(ratio(F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2)), (F.sum("pos") * F.sum("neg")).cast("double")).alias("roc_auc"))


def threshold_grid(rows: DataFrame, cuts: list[float], group: list[str] | None = None) -> DataFrame:
    """The confusion row of each cut: rows are first counted between cuts, so the grid costs no copy of the rows."""
    group = group or []
    place = sum(((F.col("score") >= c).cast("int") for c in cuts), F.lit(0))
    counts = rows.groupBy(*group, place.alias("b")).agg(F.count_if("truth").alias("pos"), F.count_if(~F.col("truth")).alias("neg"))
    each = counts.select(*group, "b", "pos", "neg", F.posexplode(F.array(*[F.lit(c) for c in cuts])).alias("i", "threshold"))
    over = F.col("b") > F.col("i")
    out = each.groupBy(*group, "threshold").agg(F.sum(F.when(over, F.col("pos")).otherwise(0)).alias("tp"), F.sum(F.when(over, F.col("neg")).otherwise(0)).alias("fp"), F.sum(F.when(~over, F.col("pos")).otherwise(0)).alias("fn"), F.sum(F.when(~over, F.col("neg")).otherwise(0)).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return out.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "fpr": ratio(fp, fp + tn)})


def calibrated_threshold(grid: DataFrame, objective: str = "f1") -> DataFrame:
    """The cut with the best F1 or Youden index, the lowest on ties; 0.5 with one class."""
    value = F.col("f1") if objective == "f1" else F.col("recall") - F.col("fpr")
    best = grid.agg(F.max_by("threshold", F.struct(F.coalesce(F.round(value, 12), F.lit(-1.0)), -F.col("threshold"))).alias("t"), F.max(F.col("tp") + F.col("fn")).alias("p"), F.max(F.col("fp") + F.col("tn")).alias("n"))
    return best.select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("t")).otherwise(F.lit(0.5)).alias("threshold"))


def threshold_at_fpr(rows: DataFrame, target: float) -> DataFrame:
    """The lowest score whose false-positive rate on negatives is at most the target."""
    counts = by_score(rows).withColumn("neg", F.col("n") - F.col("pos"))
    total = counts.agg(F.sum("neg").alias("all"))
    steps = running(counts, "score", ["neg"], descending=True).join(total)
    return steps.where(F.col("neg_before") + F.col("neg") <= target * F.col("all")).agg(F.min("score").alias("threshold"))


def reliability(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score and observed rate of each equal-width bin, the last one closed; empty bins have nulls."""
    place = F.least(F.lit(bins - 1), F.floor(F.col("score") * bins))
    found = rows.groupBy(place.alias("b")).agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"), F.avg(F.col("truth").cast("double")).alias("rate"))
    every = rows.sparkSession.range(bins).select(F.col("id").alias("bin"))
    return every.join(found, F.col("bin") == F.col("b"), "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_score", "rate")


def calibration_error(table: DataFrame) -> DataFrame:
    return table.agg((F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))) / F.sum("n")).alias("ece"))


def brier_parts(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score, its reliability, resolution and uncertainty over bins, and skill."""
    whole = rows.agg(F.avg(F.pow(F.col("score") - F.col("truth").cast("double"), 2)).alias("brier"), F.avg(F.col("truth").cast("double")).alias("base"))
    table = reliability(rows, bins).where("n > 0").join(F.broadcast(whole))
    n = F.sum("n")
    out = table.agg(F.max("brier").alias("brier"), (F.sum(F.col("n") * F.pow(F.col("mean_score") - F.col("rate"), 2)) / n).alias("reliability"), (F.sum(F.col("n") * F.pow(F.col("rate") - F.col("base"), 2)) / n).alias("resolution"), F.max(F.col("base") * (1 - F.col("base"))).alias("uncertainty"))
    return out.withColumn("skill", F.when(F.col("uncertainty") > 0, 1 - F.col("brier") / F.col("uncertainty")))


def order_statistic(rows: DataFrame, value: Column, alpha: float, group: list[str] | None = None, least: int = 0) -> DataFrame:
    """(group, q, n): the ceil((n+1)(1-alpha))-th smallest value of each group of ``least`` rows or more; q is null where n is too small for it.

    Values are counted first and placed by running counts, so no task holds a group.
    """
    group = group or []
    counts = rows.groupBy(*group, value.alias("q")).agg(F.count("*").alias("n"))
    totals = counts.groupBy(*[F.col(g).alias(f"t_{g}") for g in group]).agg(F.sum("n").alias("total"))
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"t_{g}"))
    steps = running(counts, "q", ["n"], group).withColumn("upto", F.col("n_before") + F.col("n")).join(totals, same)
    rank = F.ceil((F.col("total") + 1) * F.lit(1 - alpha) - 1e-9)
    return steps.groupBy(*group).agg(F.min(F.when(F.col("upto") >= rank, F.col("q"))).alias("q"), F.max("total").alias("n")).where(F.col("n") >= least)


def conformal_quantile(rows: DataFrame, alpha: float, group: list[str] | None = None, least: int = 0) -> DataFrame:
    """The order statistic of |truth - score| that covers 1 - alpha, for each group."""
    return order_statistic(rows, F.abs(F.col("truth").cast("double") - F.col("score")), alpha, group, least)


def calibrated_groups(rows: DataFrame, alpha: float, group: str, least: int = 8) -> DataFrame:
    """(group, q, n, method): each group's own half-width, or that of all rows where the group has too few rows for it.

    n is the number of rows behind q. With too few rows even in all, q is null: no interval is promised.
    """
    own = conformal_quantile(rows, alpha, [group])
    pooled = conformal_quantile(rows, alpha).select(F.col("q").alias("all_q"), F.col("n").alias("all_n"))
    q, kept = F.when(F.col("n") >= least, F.col("q")), F.lit("own")
    return own.join(F.broadcast(pooled)).select(group, F.coalesce(q, "all_q").alias("q"), F.when(q.isNotNull(), F.col("n")).otherwise(F.col("all_n")).alias("n"), F.when(q.isNotNull(), kept).otherwise("pooled").alias("method"))


def intervals(rows: DataFrame, q: Column) -> DataFrame:
    return rows.withColumns({"low": F.greatest(F.lit(0.0), F.col("score") - q), "high": F.least(F.lit(1.0), F.col("score") + q)})


def coverage(rows: DataFrame, nominal: float, group: list[str]) -> DataFrame:
    """Share of truths inside their interval against the nominal share, mean width, and degenerate intervals."""
    inside = F.col("truth").cast("double").between(F.col("low"), F.col("high"))
    width = F.col("high") - F.col("low")
    out = rows.groupBy(*group).agg(F.count("*").alias("n"), F.avg(inside.cast("double")).alias("coverage"), F.avg(width).alias("width"), F.count_if((width <= 0) | (width >= 1)).alias("degenerate"))
    slack = 3 * F.sqrt(F.lit(nominal * (1 - nominal)) / F.col("n"))
    return out.withColumn("ok", F.col("coverage") >= nominal - slack)


def poisson_weights(ids: np.ndarray, draws: int, seed: int = 0) -> np.ndarray:
    """rows x draws: a hash-drawn Poisson(1) weight of each row in each replicate."""
    x = ids.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(draws, dtype=np.uint64) + np.uint64(seed * draws + 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return np.searchsorted(POISSON, (x >> np.uint64(40)) / 2.0**24, side="right")


def _replicates(draws: int, seed: int):
    def run(batches):
        total, weights = np.zeros(draws), np.zeros(draws)
        for batch in batches:
            ids, d = batch.column("id").to_numpy(), batch.column("d").to_numpy()
            for at in range(0, len(ids), 4096):
                w = poisson_weights(ids[at : at + 4096], draws, seed)
                total += d[at : at + 4096] @ w
                weights += w.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), pa.array(total), pa.array(weights)], ["j", "t", "w"])

    return run


def _many_replicates(names: list[str], draws: int, seed: int):
    def run(batches):
        total, weights = np.zeros((draws, len(names))), np.zeros(draws)
        for batch in batches:
            ids = batch.column("id").to_numpy()
            d = np.stack([batch.column(f"d{i}").to_numpy() for i in range(len(names))], axis=1) if len(ids) else np.zeros((0, len(names)))
            for at in range(0, len(ids), 512):
                w = poisson_weights(ids[at : at + 512], draws, seed)
                total += w.T @ d[at : at + 512]
                weights += w.sum(axis=0)
        for i, name in enumerate(names):
            yield pa.RecordBatch.from_arrays([pa.array([name] * draws), pa.array(np.arange(draws)), pa.array(total[:, i].copy()), pa.array(weights)], ["name", "j", "t", "w"])

    return run


def paired_bootstraps(rows: DataFrame, losses: dict[str, Column], reference: Column, draws: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """(name, low, high): bounds of the mean of each loss less the reference's, on the same replicates of the same rows; rows: id (a number).

    One pass: each task folds its rows into names x draws sums, which are all that is exchanged.
    """
    names = list(losses)
    each = rows.select(F.col("id").cast("long").alias("id"), *[(losses[n] - reference).cast("double").alias(f"d{i}") for i, n in enumerate(names)])
    means = each.mapInArrow(_many_replicates(names, draws, seed), "name string, j long, t double, w double").groupBy("name", "j").agg((F.sum("t") / F.sum("w")).alias("m"))
    tail = (1 - level) / 2
    return means.groupBy("name").agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"))


def bootstrap(rows: DataFrame, a: Column, b: Column, draws: int, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Confidence bounds of the mean paired difference by Poisson-weighted resampling.

    Every row gets a hash-drawn Poisson(1) weight in each replicate, so replicates need no shuffle of rows: each task
    folds its rows into ``draws`` running sums, which are all that is exchanged.
    """
    sums = rows.select(F.col("id").cast("long"), (a - b).cast("double").alias("d")).mapInArrow(_replicates(draws, seed), "j long, t double, w double")
    means = sums.groupBy("j").agg((F.sum("t") / F.sum("w")).alias("m"))
    tail = (1 - level) / 2
    return means.agg(F.percentile("m", tail).alias("low"), F.percentile("m", 1 - tail).alias("high"), F.avg("m").alias("mean"))


def psi_edges(reference: DataFrame, bins: int = 10) -> DataFrame:
    """(feature, edges): inner bin edges at the reference's order statistics, found by running counts of its values."""
    counts = reference.groupBy("feature", "value").agg(F.count("*").alias("n"))
    totals = counts.groupBy("feature").agg(F.sum("n").alias("total")).withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(bins - 1))))
    at = F.least(F.col("total") - 1, F.greatest(F.lit(0).cast("long"), F.bround(F.col("i") * F.col("total") / bins).cast("long") - 1))
    picks = totals.select(F.col("feature").alias("f"), "i", at.alias("at"))
    ranked = running(counts, "value", ["n"], ["feature"])
    inside = (F.col("feature") == F.col("f")) & (F.col("at") >= F.col("n_before")) & (F.col("at") < F.col("n_before") + F.col("n"))
    return ranked.join(picks, inside).groupBy("feature").agg(F.array_sort(F.collect_list("value")).alias("edges"))


def bin_counts(edges: DataFrame, rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, bin, n): rows in each bin; a value's bin is the number of edges below it."""
    placed = rows.join(edges, "feature").withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col("value"))))
    return placed.groupBy(*by, "bin").agg(F.count("*").alias("n"))


def psi_of_counts(now: DataFrame, reference: DataFrame, keys: list[str], bins: int = 10, least: float = 1e-6) -> DataFrame:
    """Population stability index of each block's bin counts against the reference's."""
    share = lambda counts, by: counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))
    grid = now.select("feature", *keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    ref = share(reference, ["feature"]).select("feature", "bin", F.col("p").alias("r"))
    both = grid.join(share(now, ["feature", *keys]), ["feature", *keys, "bin"], "left").join(ref, ["feature", "bin"], "left")
    c, r = F.greatest(F.coalesce("p", F.lit(0.0)), F.lit(least)), F.greatest(F.coalesce("r", F.lit(0.0)), F.lit(least))
    return both.groupBy("feature", *keys).agg(F.bround(F.sum((c - r) * F.log(c / r)), 6).alias("psi"))


def psi(edges: DataFrame, reference: DataFrame, current: DataFrame, keys: list[str], bins: int = 10, least: float = 1e-6) -> DataFrame:
    """Population stability index of each block of ``current`` (feature and keys) against the reference; a value's bin is the number of edges below it."""
    return psi_of_counts(bin_counts(edges, current, ["feature", *keys]), bin_counts(edges, reference, ["feature"]), keys, bins, least)


def rolling_psi(edges: DataFrame, reference: DataFrame, current: DataFrame, width: int, bins: int = 10) -> DataFrame:
    """(feature, day, psi) of the blocks of ``width`` days that end at each day; the first ``width`` - 1 days have none.

    Rows are counted once, by feature, day and bin; blocks are running sums of these counts, a row for each feature, day
    and bin. Days without rows count as none.
    """
    counts = bin_counts(edges, current, ["feature", "day"])
    span = counts.groupBy("feature").agg(F.min("day").alias("low"), F.max("day").alias("high"))
    days = span.withColumn("day", F.explode(F.sequence("low", "high"))).withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    over = Window.partitionBy("feature", "bin").orderBy("day").rowsBetween(-(width - 1), 0)
    sums = days.join(counts, ["feature", "day", "bin"], "left").withColumn("n", F.sum(F.coalesce("n", F.lit(0))).over(over))
    blocks = sums.where(F.col("day") >= F.col("low") + width - 1).select("feature", "day", "bin", "n")
    full = blocks.withColumn("all", F.sum("n").over(Window.partitionBy("feature", "day"))).where("all > 0").drop("all")
    return psi_of_counts(full, bin_counts(edges, reference, ["feature"]), ["day"], bins)


def compare_snapshot(snapshot: DataFrame, live: DataFrame, bins: int = 10) -> DataFrame:
    """Index and counts of every feature that the snapshot and the live rows share."""
    count = lambda rows, name: rows.groupBy("feature").agg(F.count("*").alias(name))
    found = psi(psi_edges(snapshot, bins), snapshot, live, [], bins)
    return found.join(count(snapshot, "reference_count"), "feature").join(count(live, "current_count"), "feature")


def null_band(blocks: DataFrame, level: float) -> DataFrame:
    """(feature, limit): of a feature's sorted null indices the one at place round(level (n - 1)), from 0."""
    order = Window.partitionBy("feature").orderBy("psi")
    ranked = blocks.select("feature", "psi", (F.row_number().over(order) - 1).alias("r"), F.count("*").over(Window.partitionBy("feature")).alias("n"))
    return ranked.where(F.col("r") == F.bround(F.lit(level) * (F.col("n") - 1)).cast("long")).select("feature", F.col("psi").alias("limit"))


def banded(blocks: DataFrame, null_blocks: DataFrame, keys: list[str], level: float) -> DataFrame:
    """blocks with their feature's limit, the share (in percent) of null indices up to theirs, and the band."""
    nulls = null_blocks.select(F.col("feature").alias("f"), F.col("psi").alias("null_psi"))
    rows = blocks.join(nulls, F.col("feature") == F.col("f")).groupBy("feature", *keys, "psi").agg(F.round(100 * F.avg((F.col("null_psi") <= F.col("psi")).cast("double")), 1).alias("percentile"))
    return rows.join(null_band(null_blocks, level), "feature").withColumn("band", F.when(F.col("psi") > F.col("limit"), "exceeds_null").otherwise("within_null"))


def monitor(blocks: DataFrame, null_blocks: DataFrame, keys: list[str], level: float = 0.99) -> DataFrame:
    """Each block's worst feature against the trip point, the interpolated level quantile of the null blocks' worst indices."""
    trip = null_blocks.groupBy(*keys).agg(F.max("psi").alias("worst")).agg(F.percentile("worst", level).alias("trip"))
    now = blocks.groupBy(*keys).agg(F.max_by("feature", F.struct("psi", "feature")).alias("feature"), F.max("psi").alias("psi"))
    return now.join(trip).select(*keys, "feature", "psi", "trip", (F.col("psi") > F.col("trip")).alias("exceeds"))


def alarm_rates(blocks: DataFrame, keys: list[str], thresholds: list[float]) -> DataFrame:
    """(threshold, rate, median_single_feature): how often a block's worst index passes a fixed threshold, and a single feature's does, in the median."""
    cut = F.explode(F.array(*[F.lit(t) for t in thresholds])).alias("threshold")
    over = lambda c: F.avg((F.col(c) > F.col("threshold")).cast("double"))
    worst = blocks.groupBy(*keys).agg(F.max("psi").alias("worst")).select("worst", cut).groupBy("threshold").agg(over("worst").alias("rate"))
    single = blocks.select("feature", "psi", cut).groupBy("threshold", "feature").agg(over("psi").alias("own"))
    return worst.join(single.groupBy("threshold").agg(F.median("own").alias("median_single_feature")), "threshold")


def kaplan_meier(rows: DataFrame, group: str = "grp") -> DataFrame:
    """(group, time, at_risk, events, survival, variance) at each time with an event; nothing after all at risk have died."""
    counts = rows.groupBy(group, "duration").agg(F.count("*").alias("n"), F.count_if("event").alias("d"))
    left = Window.partitionBy(group).orderBy(F.col("duration").desc()).rowsBetween(Window.unboundedPreceding, 0)
    steps = counts.withColumn("at_risk", F.sum("n").over(left)).where("d > 0")
    upto = Window.partitionBy(group).orderBy("duration").rowsBetween(Window.unboundedPreceding, 0)
    share = F.col("d") / F.col("at_risk")
    log = F.sum(F.when(share < 1, F.log(1 - share)).otherwise(F.lit(0.0))).over(upto)
    ended = F.max((share >= 1).cast("int")).over(upto)
    green = F.sum(F.when(share < 1, F.col("d") / (F.col("at_risk") * (F.col("at_risk") - F.col("d")))).otherwise(F.lit(0.0))).over(upto)
    s = F.when(ended == 1, F.lit(0.0)).otherwise(F.exp(log))
    return steps.select(group, F.col("duration").alias("time"), "at_risk", F.col("d").alias("events"), s.alias("survival"), (s * s * green).alias("variance"))


def median_survival(curve: DataFrame, group: str = "grp", z: float = 1.959964, least_events: int = 5) -> DataFrame:
    """First time with survival at most one half, and where the log-log bands cross it; null where they don't."""
    s = F.col("survival")
    inner = (s > 0) & (s < 1)
    spread = F.when(inner, z * F.sqrt(F.col("variance")) / (s * F.abs(F.log(s))))
    low = F.when(inner, F.pow(s, F.exp(spread))).otherwise(s)
    high = F.when(inner, F.pow(s, F.exp(-spread))).otherwise(s)
    first = lambda c: F.min(F.when(c <= 0.5, F.col("time")))
    return curve.groupBy(group).agg(first(s).alias("median"), first(low).alias("median_low"), first(high).alias("median_high"), (F.sum("events") >= least_events).alias("usable"))


def survival_table(rows: DataFrame, group: str = "grp", level: float = 0.95) -> DataFrame:
    """Per group: rows, events, censored ones, the share detected, the median with its bounds (null without a crossing), whether there are events enough, and the median of the detected ones alone."""
    curve = kaplan_meier(rows, group)
    z = NormalDist().inv_cdf(0.5 + level / 2)
    known = median_survival(curve, group, z)
    crossed = F.col("median").isNotNull()
    event = F.col("event")
    counts = rows.groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(event).alias("events"), F.count_if(~event).alias("censored"), F.avg(event.cast("double")).alias("detected_fraction"),
        F.median(F.when(event, F.col("duration"))).alias("naive_median"),
    )
    out = counts.join(known, group, "left")
    return out.select(*counts.columns, "median", *[F.when(crossed, F.col(c)).alias(c) for c in ("median_low", "median_high")], F.coalesce("usable", F.lit(False)).alias("usable"))


def log_rank(rows: DataFrame, a: str, b: str, group: str = "grp") -> DataFrame:
    """Chi-square and p value of the log-rank test of two groups."""
    two = rows.where(F.col(group).isin(a, b))
    mine = F.col(group) == a
    counts = two.groupBy("duration").agg(F.count("*").alias("n"), F.count_if(mine).alias("na"), F.count_if("event").alias("d"), F.count_if(mine & F.col("event")).alias("da"))
    steps = running(counts, "duration", ["n", "na"], descending=True)
    steps = steps.select("d", "da", (F.col("n_before") + F.col("n")).alias("r"), (F.col("na_before") + F.col("na")).alias("ra")).where("d > 0")
    expected = F.col("d") * F.col("ra") / F.col("r")
    variance = F.when(F.col("r") > 1, expected * (1 - F.col("ra") / F.col("r")) * (F.col("r") - F.col("d")) / (F.col("r") - 1)).otherwise(0.0)
    out = steps.agg(F.sum("da").alias("observed"), F.sum(expected).alias("expected"), F.sum(variance).alias("variance"))
    chi = F.when(F.col("variance") > 0, F.pow(F.col("observed") - F.col("expected"), 2) / F.col("variance"))
    return out.select("observed", "expected", chi.alias("chi_square"), erfc(F.sqrt(chi / 2)).alias("p_value"))
