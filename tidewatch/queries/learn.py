"""Learned models over labelled states: K3, K29, K30, K32, K34, K35, K45."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import experiments as X
from ..operators import learn as M
from ..operators import replay as R
from ..operators import scores as S
from ..plans.tables import stored
from .replay import FEATURES, labelled
from .scores import scored as scored_lines
from .windows import rounded

QUERIES: dict = {}


def standard(spark, sf_dir):
    """Labelled states with standardised features and the label three states on."""
    rows = stored(labelled(spark, sf_dir), "labelled")
    schema = R.standardise(rows, FEATURES, F.col("scenario") < 3)
    facts = {r["feature"]: (r["mean"], r["scale"]) for r in schema.collect()}  # a row per feature
    z = rows.select("scenario", "idx", "infiltration", *[((F.coalesce(F.col(f).cast("double"), F.lit(0.0)) - facts[f][0]) / facts[f][1]).alias(f) for f in FEATURES])
    return stored(z.join(R.future_label(rows, 3).select("scenario", "idx", F.col("target").alias("label")), ["scenario", "idx"]), "standard")


def k3(spark, sf_dir):
    rows = standard(spark, sf_dir)
    model = M.fit_baseline(rows.where("scenario < 3"), FEATURES, constant=True)
    return rounded(M.predict(model, rows.where("scenario >= 3"), FEATURES).select("scenario", "idx", "label", "score"))


def k29(spark, sf_dir):
    rows = scored_lines(spark, sf_dir)
    return rounded(M.recalibrated(M.fit_isotonic(rows.where("id % 5 <> 0")), rows.where("id % 5 = 0")).select("id", "score", "calibrated"))


def k30(spark, sf_dir):
    rows = scored_lines(spark, sf_dir)
    return rounded(M.gate(M.recalibrated(M.fit_isotonic(rows.where("id % 5 <> 0")), rows.where("id % 5 = 0"))))


def k45(spark, sf_dir):
    """Average precision and AUC of the baseline and of persistence on the same rows."""
    rows = standard(spark, sf_dir)
    model = M.fit_baseline(rows.where("scenario < 3"), FEATURES, constant=True)
    test = M.predict(model, rows.where("scenario >= 3"), FEATURES).select("score", F.col("label").alias("truth"), "infiltration")
    out = None
    for name, frame in (("baseline", test.select("score", "truth")), ("persistence", test.select(F.col("infiltration").cast("double").alias("score"), "truth"))):
        part = S.average_precision(frame).join(S.roc_auc(frame)).withColumn("model", F.lit(name))
        out = part if out is None else out.union(part)
    return rounded(out)


def experiment_rows(spark, sf_dir):
    """Standardised labelled states with their stage; the label is the state's own infiltration."""
    z = standard(spark, sf_dir).drop("label", "infiltration")
    facts = labelled(spark, sf_dir).select("scenario", "idx", "stage", F.col("infiltration").alias("label"))
    return stored(z.join(facts, ["scenario", "idx"]).withColumn("id", F.concat_ws(":", "scenario", "idx")), "experiment")


def k35(spark, sf_dir):
    """Models of one, two and all three training scenarios, nested, scored on the same rows."""
    rows = experiment_rows(spark, sf_dir)
    folds = [(str(b), F.col("scenario") < b, F.col("scenario") >= 3) for b in (1, 2, 3)]
    sizes = None
    for b in (1, 2, 3):
        part = rows.where(F.col("scenario") < b).agg(F.count("*").alias("samples")).withColumn("fold", F.lit(str(b)))
        sizes = part if sizes is None else sizes.union(part)
    return rounded(X.label_efficiency(X.scored_folds(rows, FEATURES, folds), sizes, "3"))


def products(spark, sf_dir):
    return X.Products(experiment_rows(spark, sf_dir), FEATURES, F.col("scenario") < 3)


def k34(spark, sf_dir):
    """Features in the order in which they lower the training rows' score."""
    return rounded(spark.createDataFrame(X.forward_selection(products(spark, sf_dir), 4), "step int, feature string, brier double"))


def k32(spark, sf_dir):
    """The nested subsets of the forward selection against all features, with intervals and the recommended one."""
    rows = experiment_rows(spark, sf_dir).withColumn("id", F.col("scenario") * (1 << 32) + F.col("idx"))
    known = X.Products(rows, FEATURES, F.col("scenario") < 3)
    order = [f for _, f, _ in X.forward_selection(known, len(FEATURES) - 1)]
    subsets = {f"first_{n}": order[:n] for n in range(1, len(order) + 1)}
    return rounded(X.ablation_curve(rows, known, subsets, F.col("scenario") >= 3))


QUERIES |= {"k32_ablation_curve": k32, "k34_forward_selection": k34, "k35_label_efficiency": k35}
QUERIES |= {"k3_baseline_classifier": k3, "k29_isotonic": k29, "k30_recalibration_gate": k30, "k45_model_comparison": k45}
