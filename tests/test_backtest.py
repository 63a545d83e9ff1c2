"""Backtests, horizon models and history maps against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_experiments import area, newton

from tidewatch.operators import backtest as B

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def states(spark):
    """Five scenarios of 80 states; the label follows the features of three states before."""
    draw = np.random.default_rng(5)
    rows, x = [], {}
    for s in range(5):
        x[s] = draw.normal(size=(80, 3)).cumsum(axis=0) * 0.2 + draw.normal(size=(80, 3))
        late = np.concatenate((np.zeros(3), x[s][:-3, 0] - 0.4 * x[s][:-3, 1]))
        y = late + draw.normal(size=80) * 0.5 > 0.8
        stage = np.where(y, np.where(np.arange(80) % 3 == 0, "Exfil", "Recon"), "Benign")
        rows += [(s, i, str(stage[i]), bool(y[i]), *map(float, x[s][i])) for i in range(80)]
        x[s] = (x[s], y, stage)
    return spark.createDataFrame(rows, "scenario long, idx int, stage string, infiltration boolean, a double, b double, c double").repartition(3), x


def fit(x, y):
    mean, scale = x.mean(axis=0), x.std(axis=0)
    beta = newton((x - mean) / scale, y)
    return lambda z: 1 / (1 + np.exp(-((z - mean) / scale @ beta[:-1] + beta[-1])))


def best_cut(score, y):
    if y.all() or not y.any():
        return 0.5

    def f1(t):
        tp, fp, fn = (score[y] >= t).sum(), (score[~y] >= t).sum(), (score[y] < t).sum()
        return round(2 * tp / (2 * tp + fp + fn), 12)

    return min(B.GRID, key=lambda t: (-f1(t), t))


def walk(p, y, threshold, horizon=3):
    """Rows (crossed, realized, lead, phase) of one scenario by a plain loop."""
    onset = next((i for i, v in enumerate(y) if v), None)
    out = []
    for i in range(1, len(y) - horizon):
        line = [p[i]] + [0.5 + (p[i] - 0.5) * 0.85 ** (h - 1) for h in range(2, horizon + 1)]
        crossing = next((h for h, v in enumerate(line) if v >= threshold), None)
        future = y[i + 1 : i + 1 + horizon]
        first = next((h for h, v in enumerate(future) if v), None)
        lead = first - crossing if crossing is not None and first is not None and crossing <= first else None
        phase = "NO" if onset is None else "PRE" if i < onset else "DURING" if i < onset + horizon else "POST"
        out.append((crossing is not None, bool(future.any()), lead, phase))
    return out


def test_one_origin_equals_a_plain_loop(states):
    rows, x = states
    folds = B.rolling_folds(list(range(5)))
    assert [f.name for f in folds] == ["0", "1", "2"]
    got = {r["fold"]: r for r in B.backtest(rows, FEATURES, folds, 3).collect()}
    assert set(got) == {"0", "1", "2"}
    for origin in (0, 2):
        train, validation, test = range(origin + 1), origin + 1, origin + 2
        inputs = np.concatenate([x[s][0][1:-3] for s in train])
        score = fit(inputs, np.concatenate([x[s][1][4:] for s in train]))
        threshold = best_cut(score(x[validation][0][1:-3]), x[validation][1][4:])
        r = got[str(origin)]
        assert r["threshold"] == pytest.approx(threshold)
        want = walk(score(x[test][0]), x[test][1], threshold)
        assert r["forecasts"] == len(want)
        near = 1.5 / len(want)  # a score at the cut may fall on either side in the two fits
        assert r["direction_accuracy"] == pytest.approx(np.mean([a == b for a, b, *_ in want]), abs=near)
        assert r["crossing_rate"] == pytest.approx(np.mean([a for a, *_ in want]), abs=near)
        assert r["false_early_rate"] == pytest.approx(np.mean([a and not b for a, b, *_ in want]), abs=near)
        assert r["median_lead"] == np.median([lead for *_, lead, _ in want if lead is not None])
        assert r["worst_feature"] in FEATURES and r["max_psi"] > 0


def test_drift_by_fold_equals_each_fold_alone(states):
    from tidewatch.operators import scores

    rows, _ = states
    folds = B.rolling_folds(list(range(5)))
    ordered = rows.withColumn("__order", B.in_turn())
    got = {r["fold"]: r for r in B.drift_by_fold(ordered, FEATURES, folds).collect()}
    for fold in folds:
        long = lambda cond, *keys: rows.where(cond).select(*keys, F.explode(F.create_map(*[x for f in FEATURES for x in (F.lit(f), F.col(f))])).alias("feature", "value"))  # noqa: B023, E731
        reference = long(fold.train | fold.validation | fold.test)
        now = long(fold.test).withColumn("block", F.lit(0))
        nulls = long(fold.validation, (F.floor(F.col("idx") / 20)).alias("block"))
        edges = scores.psi_edges(reference)
        index = {r["feature"]: r["psi"] for r in scores.psi(edges, reference, now, ["block"]).collect()}
        limits = {}
        for r in scores.psi(edges, reference, nulls, ["block"]).collect():
            limits.setdefault(r["feature"], []).append(r["psi"])
        r = got[fold.name]
        assert r["max_psi"] == max(index.values()) and index[r["worst_feature"]] == r["max_psi"]
        assert r["drifted"] == ",".join(f for f in FEATURES if index[f] > sorted(limits[f])[round(0.99 * 3)])


def test_stage_left_out_equals_a_plain_loop(states):
    rows, x = states
    data = rows.withColumn("label", F.col("infiltration")).withColumn("order", F.col("idx") * 5 + F.col("scenario"))
    got = {r["fold"]: r for r in B.leave_one_stage_out(data, FEATURES, ["Exfil", "Recon"], 0.1).collect()}
    order = [(i, s) for i in range(80) for s in range(5)]
    z, y, stage = (np.array([x[s][k][i] for i, s in order]) for k in range(3))
    for held in ("Exfil", "Recon"):
        other = np.flatnonzero(stage != held)
        cut = int(len(other) * 0.7)
        score = fit(z[other[:cut]], y[other[:cut]])(z)
        last = other[cut:]
        negatives = np.sort(score[last][~y[last]])[::-1]
        threshold = negatives[int(len(negatives) * 0.1) - 1]
        r = got[held]
        assert r["calibration_windows"] == len(last) and r["held_windows"] == (stage == held).sum()
        assert r["threshold"] == pytest.approx(threshold, abs=2e-3)
        benign, unseen = score[stage == "Benign"], score[stage == held]
        assert r["benign_fpr"] == pytest.approx((benign >= threshold).mean(), abs=0.01)
        assert r["detection"] == pytest.approx((unseen >= threshold).mean(), abs=0.03)
        both = np.concatenate((benign, unseen))
        assert r["roc_auc"] == pytest.approx(area(both, np.arange(len(both)) >= len(benign)), abs=5e-3)


def test_cut_at_fpr(spark):
    rows = spark.createDataFrame([("a", s) for s in (0.9, 0.8, 0.8, 0.7, 0.1)] + [("b", 0.4)], "g string, score double")
    assert {r["g"]: r["threshold"] for r in B.cut_at_fpr(rows, 0.4, ["g"]).collect()} == {"a": 0.8, "b": pytest.approx(0.4 + 1e-9)}
    assert B.cut_at_fpr(rows.where("g = 'a'"), 0.8, ["g"]).first()["threshold"] == 0.7


def test_horizon_models_equal_separate_fits(states):
    rows, x = states
    lagged, names, models = B.horizon_models(rows, FEATURES, 3, 2, F.col("scenario") < 4)
    got = {(r["scenario"], r["idx"], r["horizon"]): r["score"] for r in B.horizon_scores(lagged, names, models).collect()}
    history = {s: np.array([np.concatenate([x[s][0][i - k] for k in range(3)]) for i in range(2, 80)]) for s in x}
    for h in (1, 2):
        score = fit(np.concatenate([history[s][:-h] for s in range(4)]), np.concatenate([x[s][1][2 + h :] for s in range(4)]))
        for s in (0, 4):
            for i, p in enumerate(score(history[s])):
                assert got[s, i + 2, h] == pytest.approx(p, abs=5e-3)


def test_timeline(spark):
    rows = spark.createDataFrame([(1, 2.0, 0.9, True), (2, -3.0, 0.3, None)], "id int, a_0 double, base double, has_packets boolean")
    model = B.Linear((1.0,), 0.0)
    out = {r["id"]: r for r in B.forecast_timeline(rows, ["a_0"], {2: model}, F.col("base"), 3, 0.85).collect()}
    s = 1 / (1 + np.exp(-2.0))
    assert out[1]["timeline"] == pytest.approx([0.9, s, 0.5 + 0.4 * 0.85**2]) and out[1]["lead"] == 1
    assert out[1]["predicted_stage"] == "Lateral Movement" and out[1]["warnings"] == ["some_horizons_decayed"]
    assert out[2]["lead"] is None and out[2]["warnings"] == ["some_horizons_decayed", "no_packet_features", "all_below_threshold"]
    none = B.forecast_timeline(rows, ["a_0"], {}, F.col("base"), 3, 0.85).collect()
    assert all(r["warnings"][0] == "baseline_decay_only" for r in none)


def unrolled(a, b, history, targets):
    total, p = 0.0, len(b)
    for y in targets:
        state = history @ a.T + b
        total += ((state - y) ** 2).sum()
        history = np.concatenate([history[:, p:], state], axis=1)
    return total


def test_history_map(spark, states):
    rows, x = states
    m, steps = 3, 3
    data = [x[s][0] for s in range(5)]
    history = np.concatenate([[np.concatenate(d[i - m + 1 : i + 1]) for i in range(m - 1, len(d) - steps)] for d in data])
    targets = [np.concatenate([d[m - 1 + k : len(d) - steps + k] for d in data]) for k in range(1, steps + 1)]
    sums = B.history_sums(rows, FEATURES, m, steps)
    whole = np.column_stack((np.ones(len(history)), history, *targets))
    assert np.allclose(sums, whole.T @ whole)
    # one step: ridge, its spectral norm clipped
    one = B.fit_history_map(rows, FEATURES, m, 1, limit=0.5)
    long = np.concatenate([[np.concatenate(d[i - m + 1 : i + 1]) for i in range(m - 1, len(d) - 1)] for d in data])
    ahead = np.concatenate([d[m:] for d in data])
    solved = np.linalg.solve(long.T @ long + np.eye(9), long.T @ ahead).T
    norm = np.linalg.norm(solved, 2)
    assert norm > 0.5 and one.norm_before == pytest.approx(norm) and np.allclose(one.weights, solved * 0.5 / norm)
    # the gradient from sums equals differences of the unrolled error
    draw = np.random.default_rng(1)
    a, b = draw.normal(size=(3, 9)) * 0.3, draw.normal(size=3) * 0.1
    gram, total = sums[1:10, 1:10], sums[0, 1:10]
    cross = [(sums[10 + 3 * k : 13 + 3 * k, 1:10], sums[0, 10 + 3 * k : 13 + 3 * k]) for k in range(steps)]
    ga, gb = B.multistep_gradient(a, b, gram, total, sums[0, 0], cross)
    for at in ((0, 0), (1, 4), (2, 8)):
        more, less = a.copy(), a.copy()
        more[at] += 1e-5
        less[at] -= 1e-5
        assert ga[at] == pytest.approx((unrolled(more, b, history, targets) - unrolled(less, b, history, targets)) / 2e-5, rel=1e-5)
    assert gb[1] == pytest.approx((unrolled(a, b + [0, 1e-5, 0], history, targets) - unrolled(a, b - [0, 1e-5, 0], history, targets)) / 2e-5, rel=1e-5)
    known = B.fit_history_map(rows, FEATURES, m, steps, ridge=1e-6, limit=10)
    assert unrolled(known.weights, known.bias, history, targets) < unrolled(np.linalg.solve(history.T @ history + np.eye(9), history.T @ targets[0]).T, np.zeros(3), history, targets)
    # the rollout takes the last m states, and its errors stop at a scenario's end
    out = {(r["scenario"], r["idx"], r["step"]): r for r in B.rollout_errors(B.rolled_out(rows, FEATURES, known, 2), 2).collect()}
    assert (0, 1, 1) not in out and out[0, 79, 1]["m"] is None and len(out) == 5 * 78 * 2
    now = known.roll(np.concatenate(data[0][8:11])[None], 2)[0]
    assert np.allclose(out[0, 10, 2]["state"], now[1]) and out[0, 10, 2]["m"] == pytest.approx(np.abs(now[1] - data[0][12]).mean())
    assert out[0, 10, 1]["q"] == pytest.approx(np.abs(data[0][10] - data[0][11]).mean())
