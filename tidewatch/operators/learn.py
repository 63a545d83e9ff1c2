"""Baseline classifiers, isotonic recalibration and the linear transition model, by MLlib and column math."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scores

def assemble(rows: DataFrame, features: list[str]) -> DataFrame:
    filled = rows.fillna(0.0, subset=features)
    return VectorAssembler(inputCols=features, outputCol="vector").transform(filled)


def fit_baseline(rows: DataFrame, features: list[str], label: str = "label", constant: bool = False):
    """L2 logistic regression with C = 1 and balanced class weights: regParam is 1 / sum of weights.

    With one class the fit has no finite optimum. ``constant`` takes its limit (no weights, an infinite intercept: the class
    itself is predicted), else it is an error.
    """
    counts = rows.agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p")).first()
    n, p = counts["n"], counts["p"] or 0
    if not n or not constant and not 0 < p < n:
        raise ValueError("both classes are needed")
    weight = F.when(F.col(label), n / (2 * max(p, 1))).otherwise(n / (2 * max(n - p, 1)))
    data = assemble(rows, features).withColumns({"w": weight, "y": F.col(label).cast("double")})
    return LogisticRegression(featuresCol="vector", labelCol="y", weightCol="w", regParam=1 / n, elasticNetParam=0.0, standardization=False, maxIter=200).fit(data)


def predict(model, rows: DataFrame, features: list[str]) -> DataFrame:
    scored = model.transform(assemble(rows, features))
    return scored.withColumn("score", vector_to_array("probability")[1]).drop("vector", "rawPrediction", "probability", "prediction")


def fit_isotonic(rows: DataFrame, least: int = 20):
    """Isotonic fit of truth on score; None below ``least`` rows."""
    if rows.limit(least).count() < least:
        return None
    data = rows.select(F.col("score").alias("x"), F.col("truth").cast("double").alias("y"))
    return IsotonicRegression(featuresCol="x", labelCol="y").fit(data)


CELLS = 1024


def recalibrated(model, rows: DataFrame) -> DataFrame:
    """rows with calibrated: the step of the greatest boundary at or below the score, the first one's below all, 1 above all.

    The steps are a table of CELLS + 1 rows, one for each cell of the score, with the steps that begin in it and the one before.
    """
    steps = [(float(b), float(p)) for b, p in zip(model.boundaries, model.predictions, strict=True)]
    cells: list[list[tuple[float, float]]] = [[] for _ in range(CELLS + 1)]
    for b, p in steps:
        cells[min(CELLS, max(0, int(b * CELLS)))].append((b, p))
    last, table = (float("-inf"), steps[0][1]), []
    for cell, own in enumerate(cells):
        table.append((cell, [last, *own]))
        last = own[-1] if own else last
    known = rows.sparkSession.createDataFrame(table, "cell int, steps array<struct<b: double, p: double>>")
    placed = rows.withColumn("at", F.least(F.lit(CELLS), F.greatest(F.lit(0), F.floor(F.col("score") * CELLS))).cast("int"))
    found = placed.join(known, F.col("at") == F.col("cell"))
    value = F.element_at(F.filter("steps", lambda s: s["b"] <= F.col("score")), -1)["p"]
    return found.withColumn("calibrated", F.when(F.col("score") >= steps[-1][0] + 1e-9, 1.0).otherwise(value)).drop("at", "cell", "steps")


def order_kept(rows: DataFrame) -> DataFrame:
    """(ranking_unchanged): whether calibrated never falls as the score rises.

    Scores are checked in CELLS cells, and the cells' ends against each other (CELLS + 1 rows), so no task sorts all rows.
    """
    each = rows.groupBy("score").agg(F.min("calibrated").alias("low"), F.max("calibrated").alias("high"))
    placed = each.withColumn("cell", F.least(F.lit(CELLS), F.greatest(F.lit(0), F.floor(F.col("score") * CELLS))))
    over = Window.partitionBy("cell").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("before", F.max("high").over(over))
    cells = inside.groupBy("cell").agg(F.count_if(F.col("low") < F.col("before") - 1e-12).alias("falls"), F.min("low").alias("low"), F.max("high").alias("high"))
    upto = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # of CELLS + 1 rows at most
    return cells.withColumn("before", F.max("high").over(upto)).agg((F.count_if((F.col("falls") > 0) | (F.col("low") < F.col("before") - 1e-12)) == 0).alias("ranking_unchanged"))


def gate(rows: DataFrame) -> DataFrame:
    """Brier score, bias and calibration error before and after, the mean shift, and whether the order of scores is kept; ship only if it is and the Brier score went down."""
    y = F.col("truth").cast("double")
    out = rows.agg(
        F.avg(F.pow(F.col("score") - y, 2)).alias("before"), F.avg(F.pow(F.col("calibrated") - y, 2)).alias("after"), F.avg(F.col("score") - y).alias("bias_before"),
        F.avg(F.col("calibrated") - y).alias("bias_after"), F.avg(F.abs(F.col("calibrated") - F.col("score"))).alias("mean_shift"),
    )
    error = lambda column: scores.calibration_error(scores.reliability(rows.select(F.col(column).alias("score"), "truth")))
    out = out.join(error("score").withColumnRenamed("ece", "ece_before")).join(error("calibrated").withColumnRenamed("ece", "ece_after")).join(order_kept(rows))
    return out.withColumn("ship", (F.col("after") < F.col("before")) & F.col("ranking_unchanged"))


def fit_transition(rows: DataFrame, features: list[str], ridge: float = 1.0, limit: float = 0.98) -> tuple[np.ndarray, np.ndarray]:
    """Ridge map from one state's features to the next one's: (weights p x p, bias).

    The Gram matrix is summed by Spark, one row of p(p+1) sums; only p x p numbers reach the driver. The map's
    spectral radius is held under ``limit``.
    """
    over = Window.partitionBy("scenario").orderBy("idx")
    pairs = rows.select(*features, *[F.lead(f).over(over).alias(f"n_{f}") for f in features], F.lead("idx").over(over).alias("__n")).where("__n is not null")
    left, p = [*features, None], len(features)
    term = lambda a: F.lit(1.0) if a is None else F.coalesce(F.col(a).cast("double"), F.lit(0.0))
    cells = [F.sum(term(a) * term(b)).alias(f"g{i}_{j}") for i, a in enumerate(left) for j, b in enumerate(left)]
    cells += [F.sum(term(a) * term(f"n_{b}")).alias(f"t{i}_{j}") for i, a in enumerate(left) for j, b in enumerate(features)]
    row = pairs.agg(*cells).first()
    gram = np.array([[row[f"g{i}_{j}"] or 0.0 for j in range(p + 1)] for i in range(p + 1)])
    target = np.array([[row[f"t{i}_{j}"] or 0.0 for j in range(p)] for i in range(p + 1)])
    solved = np.linalg.solve(gram + ridge * np.diag([*[1.0] * p, 1e-9]), target)
    weights, bias = solved[:p], solved[p]
    radius = max(abs(np.linalg.eigvals(weights)))
    return (weights * (limit / radius) if radius > limit else weights), bias


def rolled(rows: DataFrame, features: list[str], weights: np.ndarray, bias: np.ndarray, steps: int) -> DataFrame:
    """(scenario, idx, step, state, m, q): the state rolled out from each row, its mean absolute error and persistence's (null past the end)."""
    over = Window.partitionBy("scenario").orderBy("idx")
    now = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
    w = F.array(*[F.array(*[F.lit(float(x)) for x in column]) for column in weights.T])
    b = F.array(*[F.lit(float(x)) for x in bias])
    move = lambda v: F.zip_with(w, b, lambda r, c: F.aggregate(F.zip_with(r, v, lambda x, y: x * y), c, lambda s, x: s + x))
    rows = rows.select("scenario", "idx", now.alias("now")).withColumn("p0", F.col("now"))
    for h in range(1, steps + 1):
        rows = rows.withColumn(f"p{h}", move(F.col(f"p{h - 1}"))).withColumn(f"real{h}", F.lead("now", h).over(over))
    gap = lambda a, c: F.aggregate(F.zip_with(a, c, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / len(features)
    each = F.array(*[F.struct(F.lit(h).alias("step"), F.col(f"p{h}").alias("state"), gap(F.col(f"p{h}"), F.col(f"real{h}")).alias("m"), gap(F.col("now"), F.col(f"real{h}")).alias("q")) for h in range(1, steps + 1)])
    return rows.select("scenario", "idx", F.explode(each).alias("x")).select("scenario", "idx", "x.*")


def skill(long: DataFrame, *more) -> DataFrame:
    """Error of the map and of persistence, and skill, at each step ahead; and more aggregates."""
    out = long.groupBy("step").agg(F.avg("m").alias("error"), F.avg("q").alias("persistence"), *more)
    return out.withColumn("skill", F.when(F.col("persistence") > 0, 1 - F.col("error") / F.col("persistence")))


def rollout(rows: DataFrame, features: list[str], weights: np.ndarray, bias: np.ndarray, steps: int) -> DataFrame:
    """Mean absolute error of the map and of persistence, and skill, at each step ahead."""
    return skill(rolled(rows, features, weights, bias, steps).where("m is not null"))


def classified(long: DataFrame, model, features: list[str]) -> DataFrame:
    """rolled-out states with the baseline classifier's score."""
    return predict(model, long.select("*", *[F.col("state")[i].alias(f) for i, f in enumerate(features)]), features).drop("state", *features)
