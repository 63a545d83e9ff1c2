"""Training rows of one class: no query fails on them."""

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import backtest as B
from tidewatch.operators import experiments as X
from tidewatch.operators import learn as M


def states(spark, label):
    rows = [(s, i, f"{s}:{i}", s * 40 + i, float(i % 7), float(i % 3), "Exfiltration" if i % 2 else "Reconnaissance", label) for s in range(3) for i in range(20)]
    return spark.createDataFrame(rows, "scenario long, idx long, id string, order long, a double, b double, stage string, infiltration boolean").withColumn("label", F.col("infiltration"))


@pytest.mark.parametrize("label", [True, False])
def test_limit_of_the_fit(spark, label):
    rows = states(spark, label)
    with pytest.raises(ValueError):
        M.fit_baseline(rows, ["a", "b"])
    model = M.fit_baseline(rows, ["a", "b"], constant=True)
    assert list(model.coefficients) == [0.0, 0.0]
    assert {r["score"] for r in M.predict(model, rows, ["a", "b"]).collect()} == {float(label)}


@pytest.mark.parametrize("label", [True, False])
def test_limit_as_columns(spark, label):
    rows = states(spark, label)
    assert B.fitted(rows, ["a", "b"], "label") is None
    model = B.fitted(rows, ["a", "b"], "label", constant=True)
    assert {r["score"] for r in rows.select(model.score(B.values(["a", "b"])).alias("score")).collect()} == {float(label)}


def test_budgets_without_a_fit(spark):
    scored = X.scored_folds(states(spark, True), ["a", "b"], [("1", F.col("scenario") < 1, F.col("scenario") == 2)])
    out = X.label_efficiency(scored, spark.createDataFrame([("1", 20)], "fold string, samples long"), "1")
    assert out.count() == 0 and {"fold", "samples", "brier", "low", "high", "loss_from_full", "indistinguishable"} <= set(out.columns)


def test_stages_without_a_fit(spark):
    out = B.leave_one_stage_out(states(spark, True), ["a", "b"], ["Exfiltration", "Reconnaissance"], 0.05)
    assert out.count() == 0 and {"fold", "threshold", "detection", "roc_auc"} <= set(out.columns)


def test_origins_without_a_fit(spark):
    out = B.backtest(states(spark, True), ["a", "b"], B.rolling_folds([0, 1, 2]), 3)
    assert out.count() == 0 and {"fold", "threshold", "forecasts", "max_psi", "drifted"} <= set(out.columns)


def test_horizons_without_a_fit(spark):
    rows, names, models = B.horizon_models(states(spark, True), ["a", "b"], 2, 3, F.col("scenario") < 2)
    out = B.horizon_scores(rows, names, models)
    assert models == {} and out.count() == 0 and dict(out.dtypes)["score"] == "double" and dict(out.dtypes)["horizon"] == "int"
