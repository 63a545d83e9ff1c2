"""Backtests with calibrated cuts: models fitted once a fold, then cuts, replay and drift of all folds in one pass each.

A fold names its training, validation (calibration) and test rows. Its model is a few numbers (a weight per feature and
a bias), so the models of all folds are applied to the rows in a single scan; everything after that groups by fold.
Rows: scenario, idx (place in the scenario), stage, infiltration and features.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import decay, stage_from_probability
from ..plans.tables import stored
from . import learn, replay, scores

#: The grid of decision thresholds, the length of a null run, and the level of its limit.
GRID = [round(0.05 * i, 2) for i in range(1, 20)]
NULL_BLOCKS, NULL_LEVEL = 4, 0.99


@dataclass(frozen=True)
class Fold:
    name: str
    train: Column
    validation: Column
    test: Column


@dataclass(frozen=True)
class Linear:
    """A logistic model over raw features."""

    weights: tuple[float, ...]
    bias: float

    def score(self, columns: list[Column]) -> Column:
        margin = reduce(lambda s, x: s + x, (F.lit(w) * c for w, c in zip(self.weights, columns, strict=True)), F.lit(self.bias))
        return 1 / (1 + F.exp(-margin))


def values(features: list[str]) -> list[Column]:
    return [F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features]


def rolling_folds(scenarios: list, size: int = 1) -> list[Fold]:
    """A fold for each origin: the scenarios of ``size`` places from it on are its test, those before them its validation, all earlier ones its training."""
    out = []
    for origin in range(len(scenarios) // size - 2):
        cut = (origin + 1) * size
        inside = [F.col("scenario").isin(part) for part in (scenarios[:cut], scenarios[cut : cut + size], scenarios[cut + size : cut + 2 * size])]
        out.append(Fold(str(origin), *inside))
    return out


def with_target(states: DataFrame, horizon: int, keys: list[str] | None = None) -> DataFrame:
    """states with target: whether the state ``horizon`` places on is an infiltration (null past the end)."""
    return states.withColumn("target", F.lead("infiltration", horizon).over(Window.partitionBy(*(keys or ["scenario"])).orderBy("idx")))


def fitted(rows: DataFrame, features: list[str], label: str = "target", constant: bool = False) -> Linear | None:
    """The baseline classifier of standardised features, in terms of the raw ones; with one class None, or where ``constant`` that class."""
    schema = {r["feature"]: (r["mean"], r["scale"]) for r in replay.standardise(rows, features, F.lit(True)).collect()}  # a row per feature
    if any(m is None for m, _ in schema.values()):
        return None
    z = rows.select(F.col(label).alias("label"), *[((c - schema[f][0]) / schema[f][1]).alias(f) for f, c in zip(features, values(features), strict=True)])
    try:
        model = learn.fit_baseline(z, features, constant=constant)
    except ValueError:
        return None
    weights = [float(w) / schema[f][1] for f, w in zip(features, model.coefficients, strict=True)]
    return Linear(tuple(weights), float(model.intercept) - sum(w * schema[f][0] for f, w in zip(features, weights, strict=True)))


def applied(rows: DataFrame, features: list[str], models: dict[str, Linear], parts: dict[str, Column]) -> DataFrame:
    """rows once for each fold that has a model and a part for them, with fold, part and score: one scan for all models."""
    columns = values(features)
    none = F.lit(None).cast("double")  # folds without a model have no rows, but give the type of part
    each = [F.when(part.isNotNull() & F.lit(n in models), F.struct(F.lit(n).alias("fold"), part.alias("part"), (models[n].score(columns) if n in models else none).alias("score"))) for n, part in parts.items()]
    kept = [c for c in rows.columns if c not in ("fold", "part", "score")]
    return rows.select(*kept, F.explode(F.array_compact(F.array(*each))).alias("x")).select(*kept, "x.fold", "x.part", "x.score")


def cut_by_f1(scored: DataFrame, group: list[str]) -> DataFrame:
    """(group, threshold): the grid's cut of the best F1, the lowest on ties; 0.5 where a group has one class. scored: score, truth."""
    grid = scores.threshold_grid(scored, GRID, group)
    order = F.struct(F.coalesce(F.round("f1", 12), F.lit(0.0)), -F.col("threshold"))
    best = grid.groupBy(*group).agg(F.max_by("threshold", order).alias("t"), F.max(F.col("tp") + F.col("fn")).alias("p"), F.max(F.col("fp") + F.col("tn")).alias("n"))
    return best.select(*group, F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("t")).otherwise(F.lit(0.5)).alias("threshold"))


def cut_at_fpr(negatives: DataFrame, target: float, group: list[str]) -> DataFrame:
    """(group, threshold): the score of the highest negatives, as many of them as the target rate allows; just above all where it allows none.

    Scores are counted, and the counts run from the highest on in buckets, so no task holds a group's scores.
    """
    counts = negatives.groupBy(*group, "score").agg(F.count("*").alias("n"))
    totals = counts.groupBy(*[F.col(g).alias(f"t_{g}") for g in group]).agg(F.sum("n").alias("total"), F.max("score").alias("top"))
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"t_{g}")) for g in group))
    steps = scores.running(counts, "score", ["n"], group, descending=True).join(totals, same)
    allowed = F.floor(F.col("total") * F.lit(target))
    at = F.max(F.when((F.col("n_before") < allowed) & (allowed <= F.col("n_before") + F.col("n")), F.col("score")))
    return steps.groupBy(*group).agg(F.coalesce(at, F.max("top") + 1e-9).alias("threshold"))


def cut_report(scored: DataFrame, target: float) -> DataFrame:
    """Per fold, of rows in the parts calibration, benign and held: the cut of the calibration rows without infiltration, and what it does.

    benign_fpr and detection are shares at that cut (null without rows), ceiling is the detection at a cut made on the
    benign test rows themselves, which no deployment has; scored: fold, part, score, truth.
    """
    cut = cut_at_fpr(scored.where((F.col("part") == "calibration") & ~F.col("truth")).select("fold", "score"), target, ["fold"])
    best = cut_at_fpr(scored.where(F.col("part") == "benign").select("fold", "score"), target, ["fold"]).withColumnRenamed("threshold", "ceiling_cut")
    rows = scored.join(cut, "fold", "left").join(best, "fold", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))
    share = lambda part, c: F.avg(F.when(F.col("part") == part, (F.col("score") >= F.col(c)).cast("double")))
    held = F.when(F.col("part") == "held", F.col("score"))
    out = rows.groupBy("fold").agg(
        *[F.count_if(F.col("part") == p).alias(f"{p}_windows") for p in ("calibration", "benign", "held")], F.max("threshold").alias("threshold"),
        share("benign", "threshold").alias("benign_fpr"), share("held", "threshold").alias("detection"), share("held", "ceiling_cut").alias("ceiling"),
        F.avg(held).alias("mean_score"), F.max(held).alias("max_score"),
    )
    pairs = scored.where(F.col("part").isin("benign", "held")).select("fold", "score", (F.col("part") == "held").alias("truth"))
    return out.join(scores.roc_auc(pairs, ["fold"]), "fold", "left")


def stage_roles(rows: DataFrame, stages: list[str], share: float = 0.7) -> tuple[DataFrame, dict[str, Column], dict[str, Column]]:
    """rows with their place in time, and for each held-out stage which rows train (the first ``share`` of the other ones) and what parts the rows play.

    rows: order (a number, different for each row, that follows time) and stage. A row's place among those of other stages
    is its place among all less the number of the stage's own rows before it: one running sum for all stages.
    """
    flags = [f"__h{i}" for i in range(len(stages))]
    counts = {r["stage"]: r["n"] for r in rows.groupBy("stage").agg(F.count("*").alias("n")).collect()}  # a row per stage
    marked = rows.withColumns({"__one": F.lit(1), **{h: (F.col("stage") == s).cast("int") for h, s in zip(flags, stages, strict=True)}})
    placed = scores.running(marked, "order", ["__one", *flags])
    placed = stored(placed.select(*rows.columns, *[(F.col("__one_before") - F.col(f"{h}_before")).alias(f"__p{i}") for i, h in enumerate(flags)]), "stage-places")
    train, parts = {}, {}
    for i, s in enumerate(stages):
        other, first = F.col("stage") != s, int((sum(counts.values()) - counts.get(s, 0)) * share)
        train[s] = other & (F.col(f"__p{i}") < first)
        roles = F.array_compact(F.array(F.when(other & (F.col(f"__p{i}") >= first), F.lit("calibration")), F.when(F.col("stage") == "Benign", F.lit("benign")), F.when(~other, F.lit("held"))))
        parts[s] = F.when(F.size(roles) > 0, roles)
    return placed, train, parts


def leave_one_stage_out(rows: DataFrame, features: list[str], stages: list[str], target: float) -> DataFrame:
    """Per stage: a model and a cut made without it, on the first 70 % and the last 30 % of the other rows in time; its report on the stage and on benign rows.

    rows: order, stage, label and features. A stage without both classes in its training rows has no report.
    """
    placed, train, parts = stage_roles(rows, stages)
    models = {s: m for s in stages if (m := fitted(placed.where(train[s]), features, "label")) is not None}
    scored = applied(placed, features, models, parts).select("fold", F.explode("part").alias("part"), "score", F.col("label").alias("truth"))
    return cut_report(stored(scored, "stage-scores"), target)


def decayed(p: Column, horizon: int) -> Column:
    """The timeline without models of its own: p decayed toward one half."""
    return F.array(*[decay(p, F.lit(h)) for h in range(1, horizon + 1)])


def walked(rows: DataFrame, horizon: int, keys: list[str], min_history: int = 2) -> DataFrame:
    """Each forecast (timeline, threshold) with what came true, its phase of the attack, and its lead credit.

    A forecast crosses in the first window of its timeline at or above the threshold; it has credit where that isn't
    later than the first true window.
    """
    over, whole = Window.partitionBy(*keys, "scenario").orderBy("idx"), Window.partitionBy(*keys, "scenario")
    ahead = over.rowsBetween(1, horizon)
    begun = F.when(F.col("infiltration"), F.col("__place"))
    placed = rows.withColumn("__place", F.row_number().over(over) - 1)
    crossing = F.array_position(F.transform("timeline", lambda p: p >= F.col("threshold")), F.lit(True)) - 1
    seen = placed.withColumns({"realized": F.max("infiltration").over(ahead), "__onset": F.min(begun).over(whole), "__first": F.min(begun).over(ahead), "__seen": F.count("*").over(ahead), "__crossing": crossing})
    seen = seen.where((F.col("__place") >= min_history - 1) & (F.col("__seen") == horizon))
    late = F.col("__first") - F.col("__place") - 1
    phase = F.when(F.col("__onset").isNull(), "NO_ATTACK").when(F.col("__place") < F.col("__onset"), "PRE_ONSET").when(F.col("__place") < F.col("__onset") + horizon, "DURING_ATTACK").otherwise("POST_ATTACK")
    crossed = F.col("__crossing") >= 0
    return seen.withColumns({"crossed": crossed, "phase": phase, "lead": F.when(crossed & (F.col("__crossing") <= late), late - F.col("__crossing"))}).drop("__place", "__onset", "__first", "__seen", "__crossing")


def walk_rates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: forecasts, accuracy of the direction, rates of crossings, false early warnings and warnings by phase, and the median lead."""
    of = lambda phase: F.coalesce(F.avg(F.when(F.col("phase") == phase, F.col("crossed").cast("double"))), F.lit(0.0))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("forecasts"), F.avg((F.col("crossed") == F.col("realized")).cast("double")).alias("direction_accuracy"),
        F.avg(F.col("crossed").cast("double")).alias("crossing_rate"), F.avg((F.col("crossed") & ~F.col("realized")).cast("double")).alias("false_early_rate"),
        of("PRE_ONSET").alias("pre_onset_rate"), of("DURING_ATTACK").alias("during_attack_rate"), F.median("lead").alias("median_lead"),
    )


def long_features(rows: DataFrame, features: list[str], folds: dict[str, Column], keys: list[Column]) -> DataFrame:
    """(feature, fold, keys, value): the features' values of the rows of each fold, named fold|feature so that folds have bins of their own."""
    inside = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in folds.items()]))
    each = F.array(*[F.struct(F.lit(f).alias("name"), c.alias("value")) for f, c in zip(features, values(features), strict=True)])
    out = rows.select(*keys, F.explode(inside).alias("fold"), each.alias("__v")).select("*", F.explode("__v").alias("x")).drop("__v")
    return out.select(F.concat_ws("|", "fold", "x.name").alias("feature"), *[c for c in out.columns if c not in ("x", "fold")], "x.value")


def drift_by_fold(rows: DataFrame, features: list[str], folds: list[Fold]) -> DataFrame:
    """Per fold: the greatest index of a watched feature between test rows and all rows up to them, that feature, and the features beyond their null limit.

    The null indices are those of NULL_BLOCKS equal runs of the validation rows in time. rows: the features and __order, a
    number, different for each row, that follows time.
    """
    seen = {f.name: f.train | f.validation | f.test for f in folds}
    reference = stored(long_features(rows, features, seen, []), "drift-reference")
    current = stored(long_features(rows, features, {f.name: f.test for f in folds}, []).withColumn("block", F.lit(0)), "drift-current")
    counted = long_features(rows, features[:1], {f.name: f.validation for f in folds}, [F.col("__order")])
    ranked = stored(scores.running(counted.withColumn("one", F.lit(1)), "__order", ["one"], ["feature"]), "drift-ranks")
    sizes = ranked.groupBy("feature").agg(F.count("*").alias("n"))
    run = F.floor(F.col("n") / NULL_BLOCKS)
    place = ranked.join(sizes.where(F.col("n") >= NULL_BLOCKS), "feature").select(F.split("feature", r"\|")[0].alias("f"), F.col("__order").alias("o"), F.floor(F.col("one_before") / run).alias("block"))
    nulls = long_features(rows, features, {f.name: f.validation for f in folds}, [F.col("__order")])
    nulls = nulls.join(place, (F.split("feature", r"\|")[0] == F.col("f")) & (F.col("__order") == F.col("o"))).where(F.col("block") < NULL_BLOCKS).select("feature", "block", "value")
    edges = stored(scores.psi_edges(reference), "drift-edges")
    found = scores.psi(edges, reference, current, ["block"]).drop("block")
    banded = scores.banded(found, stored(scores.psi(edges, reference, nulls, ["block"]), "drift-null"), [], NULL_LEVEL)
    order = F.array_position(F.array(*[F.lit(f) for f in features]), F.col("name"))
    named = found.join(banded.select("feature", "band"), "feature", "left").select(F.split("feature", r"\|")[0].alias("fold"), F.split("feature", r"\|")[1].alias("name"), "psi", "band")
    drifted = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("band") == "exceeds_null", F.struct(order.alias("o"), "name")))), lambda x: x["name"]), ",")
    return named.groupBy("fold").agg(F.max("psi").alias("max_psi"), F.max_by("name", F.struct("psi", -order)).alias("worst_feature"), drifted.alias("drifted"))


def in_turn() -> Column:
    """The order of states by scenario (a number), then place."""
    return F.col("scenario").cast("long") * F.lit(1 << 40) + F.col("idx")


def backtest(states: DataFrame, features: list[str], folds: list[Fold], horizon: int, length: int = 2) -> DataFrame:
    """Per fold: the threshold calibrated on its validation rows, the replay of its test rows at it, and the drift of its test rows.

    Trained on the samples of ``length`` states whose label lies ``horizon`` states on; a fold with one class in them has no row.
    """
    rows = stored(with_target(states, horizon).withColumn("__order", in_turn()), "backtest")
    sample = F.col("target").isNotNull() & (F.col("idx") >= length - 1)
    models = {f.name: m for f in folds if (m := fitted(rows.where(f.train & sample), features)) is not None}
    kept = [f for f in folds if f.name in models]
    parts = {f.name: F.when(f.test, F.lit("test")).when(f.validation, F.lit("validation")) for f in folds}
    scored = stored(applied(rows, features, models, parts), "backtest-scores")
    return judged(scored, sample, horizon).join(drift_by_fold(rows, features, kept or folds), "fold")


def judged(scored: DataFrame, sample: Column, horizon: int) -> DataFrame:
    """Per fold of scored rows (fold, part, scenario, idx, infiltration, target, score): the calibrated threshold and the rates of the test rows' replay."""
    cuts = cut_by_f1(scored.where((F.col("part") == "validation") & sample).select("fold", "score", F.col("target").alias("truth")), ["fold"])
    test = scored.where(F.col("part") == "test").join(cuts, "fold", "left").withColumn("threshold", F.coalesce("threshold", F.lit(0.5)))
    rates = walk_rates(walked(test.withColumn("timeline", decayed(F.col("score"), horizon)), horizon, ["fold"]), ["fold"])
    return test.groupBy("fold").agg(F.max("threshold").alias("threshold")).join(rates, "fold")


# Models of several horizons over a history of states


def lagged(states: DataFrame, features: list[str], length: int) -> tuple[DataFrame, list[str]]:
    """states that have ``length`` states up to them, with the features of each as columns <feature>_<states back>."""
    over = Window.partitionBy("scenario").orderBy("idx")
    names = [f"{f}_{back}" for back in range(length) for f in features]
    columns = [F.lag(c, back).over(over).alias(f"{f}_{back}") for back in range(length) for f, c in zip(features, values(features), strict=True)]
    out = states.select("*", *columns, F.row_number().over(over).alias("__place")).where(F.col("__place") >= length)
    return out.drop("__place"), names


def horizon_models(states: DataFrame, features: list[str], length: int, horizons: int, training: Column) -> tuple[DataFrame, list[str], dict[int, Linear]]:
    """Lagged rows with the targets of all horizons (y1, y2, ..), their feature names, and a model for each horizon that has both classes."""
    over = Window.partitionBy("scenario").orderBy("idx")
    targets = {f"y{h}": F.lead("infiltration", h).over(over) for h in range(1, horizons + 1)}
    rows, names = lagged(states.withColumns(targets), features, length)
    rows = stored(rows, "lagged")
    models = {h: m for h in range(1, horizons + 1) if (m := fitted(rows.where(training & F.col(f"y{h}").isNotNull()), names, f"y{h}")) is not None}
    return rows, names, models


def horizon_scores(rows: DataFrame, names: list[str], models: dict[int, Linear]) -> DataFrame:
    """rows once for each horizon with a model: horizon and score, in one scan."""
    every = {str(h): m for h, m in models.items()}
    out = applied(rows, names, every, dict.fromkeys(every or ["0"], F.lit("all")))
    return out.withColumn("horizon", F.col("fold").cast("int")).drop("fold", "part")


def forecast_timeline(rows: DataFrame, names: list[str], models: dict[int, Linear], baseline: Column, horizons: int, threshold: float) -> DataFrame:
    """rows with timeline (a probability per horizon), lead (first horizon at the threshold, else null), peak, predicted stage and warnings.

    A horizon without a model has the baseline's probability decayed toward one half; without any model all have, and the
    warning says so.
    """
    columns = values(names)
    points = F.array(*[models[h].score(columns) if h in models else decay(baseline, F.lit(h)) for h in range(1, horizons + 1)])
    out = rows.withColumn("timeline", points)
    lead = F.array_position(F.transform("timeline", lambda p: p >= threshold), F.lit(True))
    fallback = "baseline_decay_only" if not models else None if len(models) == horizons else "some_horizons_decayed"
    warnings = F.array_compact(F.array(F.lit(fallback).cast("string"), F.when(~F.coalesce(F.col("has_packets"), F.lit(False)), F.lit("no_packet_features")), F.when(F.array_max("timeline") < threshold, F.lit("all_below_threshold"))))
    return out.withColumns({"lead": F.when(lead > 0, lead), "peak": F.array_max("timeline")}).withColumns({"predicted_stage": stage_from_probability(F.col("peak")), "warnings": warnings})


# Linear maps of a history of states to the next one


@dataclass(frozen=True)
class HistoryMap:
    """Next state = weights (p x m p, oldest state first) times the last m states + bias."""

    weights: np.ndarray
    bias: np.ndarray
    history: int
    norm_before: float

    def roll(self, history: np.ndarray, steps: int) -> np.ndarray:
        """rows x steps x p from rows x (m p)."""
        out, width = [], len(self.bias)
        for _ in range(steps):
            state = history @ self.weights.T + self.bias
            out.append(state)
            history = np.concatenate([history[:, width:], state], axis=1)
        return np.stack(out, axis=1)


def history_sums(states: DataFrame, features: list[str], history: int, steps: int) -> np.ndarray:
    """Sums of products of [constant, the last ``history`` states (oldest first), the next ``steps`` states], over all rows that have them all.

    One aggregate: (1 + (history + steps) p)**2 / 2 sums, whatever the rows.
    """
    over = Window.partitionBy("scenario").orderBy("idx")
    names = [(f, back) for back in range(history - 1, -steps - 1, -1) for f in features]
    columns = [F.lag(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), back).over(over) if back >= 0 else F.lead(F.coalesce(F.col(f).cast("double"), F.lit(0.0)), -back).over(over) for f, back in names]
    rows = states.select(F.array(F.lit(1.0), *columns).alias("v"), F.forall(F.array(*columns), lambda x: x.isNotNull()).alias("whole")).where("whole").select("v")
    size = len(names) + 1

    def products(batches):
        import pyarrow as pa

        total = np.zeros((size, size))
        for batch in batches:
            x = np.asarray(batch.column("v").flatten()).reshape(-1, size)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size)), pa.array(total.reshape(-1))], ["at", "s"])

    found = rows.mapInArrow(products, "at long, s double").groupBy("at").agg(F.sum("s").alias("s")).toPandas()  # size**2 rows
    out = np.zeros(size * size)
    out[found["at"].to_numpy()] = found["s"].to_numpy()
    return out.reshape(size, size)


def fit_history_map(states: DataFrame, features: list[str], history: int = 3, steps: int = 3, ridge: float = 1.0, limit: float = 0.98, iterations: int = 400) -> HistoryMap:
    """The map that makes the squared error of 1 to ``steps`` states ahead least, its spectral norm held under ``limit``.

    Unrolled states are linear in the history, so the error and its gradient follow from the sums of products alone. It
    starts at the one-step ridge fit and takes Adam steps of falling size.
    """
    sums, p = history_sums(states, features, history, steps), len(features)
    d, n = history * p, sums[0, 0]
    if n == 0:
        raise ValueError("no run of states is long enough for the history and steps")
    gram, total = sums[1 : d + 1, 1 : d + 1], sums[0, 1 : d + 1]
    targets = [(sums[1 + d + k * p : 1 + d + (k + 1) * p, 1 : d + 1], sums[0, 1 + d + k * p : 1 + d + (k + 1) * p]) for k in range(steps)]
    a = np.linalg.solve(gram + ridge * np.eye(d), targets[0][0].T).T
    b = np.zeros(p)
    moments = [np.zeros_like(x) for x in (a, a, b, b)]
    for i in range(1, (iterations if steps > 1 else 0) + 1):
        ga, gb = multistep_gradient(a, b, gram, total, n, targets)
        ga, gb = ga / (n * p * steps) + 2 * ridge * a, gb / (n * p * steps)
        rate = 0.01 / (1 + 0.005 * i)
        out = []
        for x, g, k in ((a, ga, 0), (b, gb, 2)):
            moments[k] = 0.9 * moments[k] + 0.1 * g
            moments[k + 1] = 0.999 * moments[k + 1] + 0.001 * g * g
            out.append(x - rate * (moments[k] / (1 - 0.9**i)) / (np.sqrt(moments[k + 1] / (1 - 0.999**i)) + 1e-8))
        a, b = out
    norm = float(np.linalg.norm(a, 2))
    clip = limit / norm if norm > limit else 1.0
    return HistoryMap(a * clip, b * clip, history, norm)


def multistep_gradient(a: np.ndarray, b: np.ndarray, gram: np.ndarray, total: np.ndarray, n: float, targets: list) -> tuple[np.ndarray, np.ndarray]:
    """Of the summed squared error of all steps, by the weights and the bias, from sums of products."""
    p, d = a.shape
    maps, shifts = [np.eye(d)], [np.zeros(d)]  # the history before step k is maps[k] x + shifts[k] for the history x
    states = []
    for _ in targets:
        m, c = a @ maps[-1], a @ shifts[-1] + b
        states.append((m, c))
        maps.append(np.concatenate([maps[-1][p:], m]))
        shifts.append(np.concatenate([shifts[-1][p:], c]))
    ga, gb = np.zeros_like(a), np.zeros_like(b)
    later, later_shift = np.zeros((d, d)), np.zeros(d)
    for k in range(len(targets) - 1, -1, -1):
        (m, c), (cross, sums) = states[k], targets[k]
        gm = 2 * (m @ gram + np.outer(c, total) - cross) + later[d - p :]
        gc = 2 * (m @ total + n * c - sums) + later_shift[d - p :]
        ga += gm @ maps[k].T + np.outer(gc, shifts[k])
        gb += gc
        before, before_shift = a.T @ gm, a.T @ gc
        before[p:] += later[: d - p]
        before_shift[p:] += later_shift[: d - p]
        later, later_shift = before, before_shift
    return ga, gb


def rolled_out(states: DataFrame, features: list[str], known: HistoryMap, steps: int) -> DataFrame:
    """states that have the map's history, with now (their features) and rolled (an array of the next ``steps`` states)."""
    over = Window.partitionBy("scenario").orderBy("idx").rowsBetween(-(known.history - 1), 0)
    rows = states.withColumn("now", F.array(*values(features))).withColumn("__past", F.collect_list("now").over(over)).where(F.size("__past") == known.history)

    def roll(past: pd.Series) -> pd.Series:
        if not len(past):
            return pd.Series([], dtype=object)
        return pd.Series(list(known.roll(np.array([np.asarray(x, float) for x in past]), steps).tolist()))

    return rows.withColumn("rolled", F.pandas_udf(roll, "array<array<double>>")(F.flatten("__past"))).drop("__past")


def rollout_errors(rows: DataFrame, steps: int, keys: list[str] | None = None) -> DataFrame:
    """(scenario, idx, step, state, m, q) of rolled_out rows: mean absolute errors of the map and of persistence, null past the end."""
    over = Window.partitionBy("scenario").orderBy("idx")
    real = F.array(*[F.lead("now", h).over(over) for h in range(1, steps + 1)])
    gap = lambda a, c: F.aggregate(F.zip_with(a, c, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)
    each = rows.withColumn("real", real).select("scenario", "idx", *(keys or []), "now", F.posexplode(F.arrays_zip("rolled", "real")).alias("at", "x"))
    real_at = F.col("x").getField("real")
    return each.select("scenario", "idx", *(keys or []), (F.col("at") + 1).alias("step"), F.col("x.rolled").alias("state"), F.when(real_at.isNotNull(), gap(F.col("x.rolled"), real_at)).alias("m"), F.when(real_at.isNotNull(), gap(F.col("now"), real_at)).alias("q"))


def rolled_timeline(rows: DataFrame, features: list[str], model: Linear) -> DataFrame:
    """rolled_out rows with timeline: the classifier's probability of each simulated state."""
    return rows.withColumn("timeline", F.transform("rolled", lambda s: model.score([s[i] for i in range(len(features))])))
