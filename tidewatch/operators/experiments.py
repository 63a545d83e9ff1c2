"""Experiments over labelled states: fits on parts of the data scored on others, and feature budgets from sums of products.

A fold is a fit on the rows of one condition and scores on those of another. All folds' scores make one table, whose
metrics are grouped aggregates. Feature subsets are judged by the linear probability model (ridge): one pass sums the
products of all features, from which every subset's fit and Brier score follow, so no subset reads the rows again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import stored
from . import learn, scores


def scored_folds(rows: DataFrame, features: list[str], folds: list[tuple[str, Column, Column]]) -> DataFrame:
    """(fold, id, score, truth) of the folds (name, training rows, scored rows); rows: id, label and features.

    A fold without both classes in its training rows has no scores. Folds that train on the same rows share one fit.
    """
    fits, out = {}, None
    for name, train, test in folds:
        key = str(train)
        if key not in fits:
            try:
                fits[key] = learn.fit_baseline(rows.where(train), features)
            except ValueError:
                fits[key] = None
        if fits[key] is None:
            continue
        part = learn.predict(fits[key], rows.where(test), features).select(F.lit(name).alias("fold"), "id", "score", F.col("label").alias("truth"))
        out = part if out is None else out.union(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], "fold string, id string, score double, truth boolean")
    return stored(out, "folds")


def fold_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per fold: counts, confusion rates at the threshold, Brier score and ROC-AUC (null with one class)."""
    base = scored.groupBy("fold").agg(F.count("*").alias("n"), F.count_if("truth").alias("positives"), F.avg(F.pow(F.col("score") - F.col("truth").cast("double"), 2)).alias("brier"))
    rates = scores.confusion(scored, F.lit(threshold), ["fold"]).select("fold", "precision", "recall", "f1", "fpr")
    return base.join(rates, "fold").join(scores.roc_auc(scored, ["fold"]), "fold")


def leave_one_stage_out(stages: list[str], train: Column, test: Column) -> list[tuple[str, Column, Column]]:
    """A fold for each attack stage: trained without it, scored on it and on benign rows."""
    return [(s, train & (F.col("stage") != s), test & F.col("stage").isin(s, "Benign")) for s in stages]


def rolling_origin(origins: list[int], length: int, gap: int) -> list[tuple[str, Column, Column]]:
    """A fold for each origin: trained on states whose label lies before it, scored on the ``length`` states from it on."""
    return [(str(o), F.col("idx") + gap < o, F.col("idx").between(o, o + length - 1)) for o in origins]


def cross_periods(period: Column, names: list[str]) -> list[tuple[str, Column, Column]]:
    """A fold for each ordered pair of different periods: trained on one, scored on the other."""
    return [(f"{a}>{b}", period == a, period == b) for a in names for b in names if a != b]


def label_efficiency(scored: DataFrame, sizes: DataFrame, full: str, draws: int = 200) -> DataFrame:
    """Per budget (fold): samples, Brier score, its loss from the full budget's, a paired confidence interval, and whether it spans 0."""
    error = F.pow(F.col("score") - F.col("truth").cast("double"), 2)
    each = scored.select("fold", "id", error.alias("error"))
    best = each.where(F.col("fold") == full).select(F.col("id").alias("i"), F.col("error").alias("full_error"))
    pairs = stored(each.join(best, F.col("id") == F.col("i")).select("fold", F.xxhash64("i").alias("id"), "error", "full_error"), "pairs")
    out = scored.sparkSession.createDataFrame([], "brier double, reference_brier double, low double, high double, fold string")  # no fold has both classes
    for (fold,) in sorted(tuple(r) for r in pairs.select("fold").distinct().collect()):  # a row per budget
        own = pairs.where(F.col("fold") == fold)
        base = own.agg(F.avg("error").alias("brier"), F.avg("full_error").alias("reference_brier"))
        part = base.join(scores.bootstrap(own, F.col("error"), F.col("full_error"), draws).select("low", "high")).withColumn("fold", F.lit(fold))
        out = out.union(part)
    out = out.withColumns({"loss_from_full": F.col("brier") - F.col("reference_brier"), "indistinguishable": (F.col("low") <= 0) & (F.col("high") >= 0)})
    return out.join(sizes, "fold")


class Products:
    """Sums of products of features (with a constant) and label over training and held-out rows."""

    def __init__(self, rows: DataFrame, features: list[str], training: Column, ridge: float = 1.0) -> None:
        self.features, self.ridge = features, ridge
        value = lambda f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) if f else F.lit(1.0)
        names, y = [*features, None], F.col("label").cast("double")
        cells = [F.sum(value(a) * value(b)).alias(f"g{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
        cells += [F.sum(value(a) * y).alias(f"t{i}") for i, a in enumerate(names)]
        found = {r["training"]: r for r in rows.groupBy(training.alias("training")).agg(*cells, F.sum(y * y).alias("yy"), F.count("*").alias("n")).collect()}  # two rows
        size = len(names)
        self.sums = {}
        for part, r in found.items():
            gram = np.array([[r[f"g{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)])
            self.sums[part] = (gram, np.array([r[f"t{i}"] for i in range(size)]), r["yy"], r["n"])

    def fit(self, chosen: list[str]) -> np.ndarray:
        """Weights of the chosen features and the constant, by the training rows."""
        at = self.places(chosen)
        gram, target, _, _ = self.sums[True]
        return np.linalg.solve(gram[np.ix_(at, at)] + self.ridge * np.diag([*[1.0] * len(chosen), 1e-9]), target[at])

    def places(self, chosen: list[str]) -> list[int]:
        return [self.features.index(f) for f in chosen] + [len(self.features)]

    def brier(self, chosen: list[str], training: bool = False) -> float:
        """Brier score of the ridge fit on the chosen features, of the held-out or the training rows."""
        at, weights = self.places(chosen), self.fit(chosen)
        gram, target, yy, n = self.sums[training]
        return float((yy - 2 * weights @ target[at] + weights @ gram[np.ix_(at, at)] @ weights) / n)


def forward_selection(products: Products, most: int) -> list[tuple[int, str, float]]:
    """(step, feature, brier): the feature that lowers the training rows' score most is taken next, the first in the features' order on ties.

    The held-out rows take no part, so that they can judge the subsets later.
    """
    chosen, out = [], []
    for step in range(1, min(most, len(products.features)) + 1):
        best = min((round(products.brier([*chosen, f], training=True), 12), i, f) for i, f in enumerate(products.features) if f not in chosen)
        chosen.append(best[2])
        out.append((step, best[2], best[0]))
    return out


#: Collection tiers from the cheapest on, and the prefixes of the features that need more than the first.
TIERS = ("flow_window", "flow_per_flow", "packet")
PACKET_PREFIXES = ("ttl", "frag", "retransmission", "syn_count", "ack_count", "rst_count", "tcp_flags", "payload_size", "window_size", "ip_flags")
PER_FLOW_PREFIXES = ("iat", "src_port", "dst_port", "flow_duration", "bidirectional", "flow_event", "source_port")


def tier(name: Column) -> Column:
    """The collection tier that a feature of this name needs; the cheapest for a name with no known prefix."""
    begins = lambda prefixes: F.lower(name).rlike("^(" + "|".join(prefixes) + ")")
    return F.when(begins(PACKET_PREFIXES), "packet").when(begins(PER_FLOW_PREFIXES), "flow_per_flow").otherwise("flow_window")


def subset_costs(subsets: DataFrame) -> DataFrame:
    """(subset, n_features, cost, tiers) of rows (subset, feature): the highest tier plus the mean one, counted from 1."""
    rank = F.array_position(F.array(*[F.lit(t) for t in TIERS]), tier(F.col("feature")))
    out = subsets.groupBy("subset").agg(F.count("*").alias("n_features"), (F.max(rank) + F.avg(rank)).alias("cost"), F.array_sort(F.collect_set(rank)).alias("ranks"))
    return out.select("subset", "n_features", "cost", F.array_join(F.transform("ranks", lambda r: F.element_at(F.array(*[F.lit(t) for t in TIERS]), r.cast("int"))), ",").alias("tiers"))


def ablation_curve(rows: DataFrame, products: Products, subsets: dict[str, list[str]], held: Column, draws: int = 2000) -> DataFrame:
    """Per subset: its size, cost, held-out Brier score, loss from the full set with a paired interval, and whether it is the one to recommend.

    A subset is indistinguishable where the interval holds 0; of these the one of the fewest features, then the least cost,
    is recommended, and none where there is none. rows: id (a number), label and features. All subsets are judged in one
    pass on the same replicates.
    """
    spark = rows.sparkSession
    value = lambda f: F.coalesce(F.col(f).cast("double"), F.lit(0.0))

    def error(chosen: list[str]) -> Column:
        weights = products.fit(chosen).tolist()
        fitted = sum((value(f) * w for f, w in zip(chosen, weights, strict=False)), F.lit(weights[-1]))
        return F.pow(fitted - F.col("label").cast("double"), 2)

    bounds = scores.paired_bootstraps(rows.where(held), {n: error(c) for n, c in subsets.items()}, error(products.features), draws)
    full = products.brier(products.features)
    known = spark.createDataFrame([(n, products.brier(c), products.brier(c) - full) for n, c in subsets.items()], "subset string, brier double, loss_from_full double")
    costs = subset_costs(spark.createDataFrame([(n, f) for n, c in subsets.items() for f in c], "subset string, feature string"))
    out = known.join(costs, "subset").join(bounds.withColumnRenamed("name", "subset"), "subset")
    out = out.withColumn("indistinguishable", (F.col("low") <= 0) & (F.col("high") >= 0))
    best = out.where("indistinguishable").agg(F.min_by("subset", F.struct("n_features", "cost", "subset")).alias("best"))  # one row
    return out.crossJoin(F.broadcast(best)).withColumn("recommended", F.coalesce(F.col("subset") == F.col("best"), F.lit(False))).drop("best")
