"""Fits and feature budgets against numpy over the same rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import experiments, learn

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def table(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(400, 3))
    y = x[:, 0] - 0.5 * x[:, 1] + draw.normal(size=400) * 0.7 > 0.4
    rows = [(str(i), i % 4, i, "Recon" if y[i] and i % 2 else "Exfil" if y[i] else "Benign", bool(y[i]), *map(float, x[i])) for i in range(400)]
    return spark.createDataFrame(rows, "id string, scenario int, idx int, stage string, label boolean, a double, b double, c double"), x, y


def newton(x, y):
    """L2 logistic regression with C = 1 and balanced weights, free intercept."""
    n, p = len(y), y.sum()
    w = np.where(y, n / (2 * p), n / (2 * (n - p)))
    z, beta = np.column_stack((x, np.ones(n))), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        q = 1 / (1 + np.exp(-z @ beta))
        gradient = z.T @ (w * (q - y)) + np.append(beta[:-1], 0)
        hessian = z.T @ (z * (w * q * (1 - q))[:, None]) + np.diag([*[1.0] * x.shape[1], 0])
        beta = beta - np.linalg.solve(hessian, gradient)
    return beta


def area(score, y):
    a, b = score[y], score[~y]
    return ((a[:, None] > b).mean() + 0.5 * (a[:, None] == b).mean()) if len(a) and len(b) else None


def test_baseline_equals_newton(table):
    rows, x, y = table
    model = learn.fit_baseline(rows, FEATURES)
    assert np.allclose([*model.coefficients, model.intercept], newton(x, y), atol=2e-3)


def test_folds_equal_numpy(table):
    rows, x, y = table
    at = np.arange(400)
    folds = experiments.leave_one_stage_out(["Exfil", "Recon"], F.col("scenario") < 3, F.col("scenario") >= 3) + experiments.rolling_origin([200], 100, 3) + experiments.cross_periods(F.col("scenario"), [0, 1])
    got = {r["fold"]: r for r in experiments.fold_metrics(experiments.scored_folds(rows, FEATURES, folds)).collect()}
    stage = np.where(y & (at % 2 == 1), "Recon", np.where(y, "Exfil", "Benign"))
    want = {"200": (at + 3 < 200, (at >= 200) & (at < 300)), "0>1": (at % 4 == 0, at % 4 == 1), "1>0": (at % 4 == 1, at % 4 == 0)}
    want |= {s: ((at % 4 < 3) & (stage != s), (at % 4 == 3) & ((stage == s) | (stage == "Benign"))) for s in ("Exfil", "Recon")}
    assert set(got) == set(want)
    for name, (train, test) in want.items():
        beta = newton(x[train], y[train])
        score = 1 / (1 + np.exp(-(x[test] @ beta[:-1] + beta[-1])))
        assert got[name]["n"] == test.sum() and got[name]["positives"] == y[test].sum()
        assert got[name]["brier"] == pytest.approx(((score - y[test]) ** 2).mean(), abs=2e-3)
        assert got[name]["roc_auc"] == pytest.approx(area(score, y[test]), abs=5e-3)


def test_feature_budgets_equal_least_squares(spark, table):
    from tidewatch.operators import scores

    rows, x, y = table
    train = np.arange(400) % 4 < 3
    products = experiments.Products(rows, FEATURES, F.col("scenario") < 3)

    def errors(chosen):
        z = np.column_stack((x[:, chosen], np.ones(400)))
        beta = np.linalg.solve(z[train].T @ z[train] + np.diag([*[1.0] * len(chosen), 1e-9]), z[train].T @ y[train])
        return (z @ beta - y) ** 2

    assert products.brier(FEATURES) == pytest.approx(errors([0, 1, 2])[~train].mean())
    chosen = []
    for _, feature, value in experiments.forward_selection(products, 3):  # ranked on the training rows alone
        options = {FEATURES[i]: errors([*chosen, i])[train].mean() for i in range(3) if i not in chosen}
        assert feature == min(options, key=options.get) and value == pytest.approx(options[feature])
        chosen.append(FEATURES.index(feature))
    subsets = {"one": ["a"], "two": ["a", "b"], "all": FEATURES}
    numbered = rows.withColumn("id", F.col("idx"))
    got = {r["subset"]: r for r in experiments.ablation_curve(numbered, products, subsets, F.col("scenario") >= 3, draws=300).collect()}
    held = np.flatnonzero(~train)
    weights = scores.poisson_weights(held, 300)
    for name, features in subsets.items():
        d = (errors([FEATURES.index(f) for f in features]) - errors([0, 1, 2]))[held]
        means = (weights * d[:, None]).sum(axis=0) / weights.sum(axis=0)
        low, high = np.quantile(means, [0.025, 0.975])
        r = got[name]
        assert (r["low"], r["high"], r["loss_from_full"]) == pytest.approx((low, high, d.mean()), abs=1e-9)
        assert r["indistinguishable"] == (low <= 1e-12 and high >= -1e-12) and r["n_features"] == len(features) and r["cost"] == 2.0
    fine = [n for n in ("one", "two", "all") if got[n]["indistinguishable"]]
    assert [n for n in got if got[n]["recommended"]] == fine[:1]


def test_tiers_and_costs(spark):
    rows = [("s", f) for f in ("bytes_mean", "iat_mean", "ttl_mean")] + [("t", "bytes_sum"), ("u", "dst_port_count"), ("u", "total_bytes")]
    got = {r["subset"]: (r["n_features"], r["cost"], r["tiers"]) for r in experiments.subset_costs(spark.createDataFrame(rows, "subset string, feature string")).collect()}
    assert got == {"s": (3, 5.0, "flow_window,flow_per_flow,packet"), "t": (1, 2.0, "flow_window"), "u": (2, 3.5, "flow_window,flow_per_flow")}


def test_label_budgets(spark, table):
    rows, _, _ = table
    folds = [(str(b), F.col("scenario") < b, F.col("scenario") >= 3) for b in (1, 3)]
    scored = experiments.scored_folds(rows, FEATURES, folds)
    sizes = spark.createDataFrame([("1", 100), ("3", 300)], "fold string, samples long")
    got = {r["fold"]: r for r in experiments.label_efficiency(scored, sizes, "3").collect()}
    assert got["3"]["loss_from_full"] == 0 and got["3"]["indistinguishable"] and got["1"]["samples"] == 100
    assert got["1"]["low"] <= got["1"]["loss_from_full"] <= got["1"]["high"]


def test_isotonic_equals_pooling(spark):
    draw = np.random.default_rng(4)
    score = np.round(draw.random(300), 2)
    truth = draw.random(300) < score**2
    rows = spark.createDataFrame([(float(s), bool(t)) for s, t in zip(score, truth, strict=True)], "score double, truth boolean")
    got = {r["score"]: r["calibrated"] for r in learn.recalibrated(learn.fit_isotonic(rows), rows).distinct().collect()}
    blocks = []
    for s in sorted(set(score)):
        blocks.append([truth[score == s].sum(), (score == s).sum(), [s]])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            b = blocks.pop()
            blocks[-1] = [blocks[-1][0] + b[0], blocks[-1][1] + b[1], blocks[-1][2] + b[2]]
    want = {s: a / n for a, n, values in blocks for s in values}
    between = spark.createDataFrame([(float(max(blocks[0][2])) + 0.004,), (-0.5,), (1.5,)], "score double")
    step = {r["score"]: r["calibrated"] for r in learn.recalibrated(learn.fit_isotonic(rows), between).collect()}
    assert list(step.values()) == pytest.approx([want[max(blocks[0][2])], want[min(want)], 1.0])
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], abs=1e-9) for s in want)


def test_transition_equals_ridge(spark):
    draw = np.random.default_rng(6)
    x = draw.normal(size=(60, 2)).cumsum(axis=0) * 0.3
    rows = spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(x)], "scenario int, idx int, a double, b double")
    weights, bias = learn.fit_transition(rows, ["a", "b"])
    z = np.column_stack((x[:-1], np.ones(59)))
    solved = np.linalg.solve(z.T @ z + np.diag([1, 1, 1e-9]), z.T @ x[1:])
    radius = max(abs(np.linalg.eigvals(solved[:2])))
    assert np.allclose(weights, solved[:2] * min(1, 0.98 / radius)) and np.allclose(bias, solved[2])


def test_pooled_fallback_and_bands(spark):
    from tidewatch.operators import scores, whatif

    # group a: 19 residuals 0.01 to 0.19, rank 18; b has 3 rows, c has 8 rows, whose rank 9 is over 8
    rows = [("a", i / 100) for i in range(1, 20)] + [("b", 0.9)] * 3 + [("c", 0.5)] * 8
    data = spark.createDataFrame([(g, s, 0.0) for g, s in rows], "g string, score double, truth double")
    got = {r["g"]: (r["q"], r["n"], r["method"]) for r in scores.calibrated_groups(data, 0.1, "g").collect()}
    assert got == {"a": (0.18, 19, "own"), "b": (0.9, 30, "pooled"), "c": (0.9, 30, "pooled")}
    few = {r["g"]: r["q"] for r in scores.calibrated_groups(data.where("g = 'b'"), 0.1, "g").collect()}
    assert few == {"b": None}
    fit = spark.createDataFrame([(0.05, y / 10) for y in range(3, 8)], "score double, truth double")
    cal = spark.createDataFrame([(0.05, y / 20) for y in range(1, 20)], "score double, truth double")
    out = whatif.conformalised_bands(fit, cal, 0.5).first()
    low, high = np.percentile([0.3, 0.4, 0.5, 0.6, 0.7], [25, 75])
    tau = sorted(max(low - y / 20, y / 20 - high) for y in range(1, 20))[9]
    assert out["tau"] == pytest.approx(tau) and out["low"] == pytest.approx(low - tau) and out["high"] == pytest.approx(high + tau)


def test_permuted(spark):
    from tidewatch.operators import whatif

    long = spark.createDataFrame([(1, "a", 2.0, 1.0), (1, "b", 0.0, 5.0)], "id long, feature string, z double, weight double")
    reference = spark.createDataFrame([(0, "a", 0.0), (1, "a", 0.0), (0, "b", 0.0), (1, "b", 0.0)], "place int, feature string, other double")
    got = {r["feature"]: r["attribution"] for r in whatif.permuted(long, reference, ["id"], -1.0).collect()}
    s = lambda x: 1 / (1 + np.exp(-x))
    assert got == {"a": pytest.approx(s(1.0) - s(-1.0)), "b": pytest.approx(0.0)}
    assert whatif.permuted(long, reference.limit(0), ["id"], -1.0).count() == 0
