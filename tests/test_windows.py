"""Hand-computed window cases."""

from pyspark.sql import functions as F

from tidewatch.functions import scalars as S
from tidewatch.operators import scores, windows

SECOND = 1_000_000


def test_three_events_make_three_windows(spark):
    rows = [("f1", "s", 0, "a", "b", 100.0), ("f2", "s", 40 * SECOND, "a", "b", 200.0), ("f3", "s", 75 * SECOND, "c", "d", 50.0)]
    events = spark.createDataFrame(rows, "event_id string, scenario string, us long, src string, dst string, bytes double")
    members = windows.assign(events, 60 * SECOND, 30 * SECOND)
    out = {r["k"]: (sorted(r["ids"]), r["b"]) for r in members.groupBy("k").agg(F.collect_list("event_id").alias("ids"), F.sum("bytes").alias("b")).collect()}
    assert out == {0: (["f1", "f2"], 300.0), 1: (["f2", "f3"], 250.0), 2: (["f3"], 50.0)}


def test_single_value_has_no_spread(spark):
    events = spark.createDataFrame([("s", 0, 5.0)], "scenario string, k long, v double")
    row = events.groupBy("scenario", "k").agg(*windows.value_stats("v"), *windows.percentiles("v")).first()
    assert row["v_sum"] == 5.0 and row["v_std"] is None and row["v_p50"] is None


def test_scalars(spark):
    row = spark.range(1).select(
        S.flag_mask(F.lit("SYN, ACK")).alias("a"), S.flag_mask(F.lit("SYN NOPE")).alias("b"), S.protocol_number(F.lit("TCP")).alias("c"), S.protocol_number(F.lit("47")).alias("d"),
        S.url_host(F.lit("HTTP://Ex.COM:81/x")).alias("e"), S.band(F.lit(0.2), 0.1, 0.3).alias("f"), S.severity(F.lit(0.85)).alias("g"), S.erfc(F.lit(1.0)).alias("h"),
        S.day_first_timestamp(F.lit("3/7/2017 2:05")).cast("string").alias("i"), S.label_text(F.lit("Web Attack – XSS")).alias("j"), S.any_timestamp(F.lit("1700000000")).cast("string").alias("k"),
    ).first()
    assert (row["a"], row["b"], row["c"], row["d"], row["e"]) == (18, None, 6, 47, "ex.com:81")
    assert abs(row["f"] - 0.5) < 1e-9 and row["g"] == "critical" and abs(row["h"] - 0.157299207) < 1e-6
    assert row["i"] == "2017-07-03 14:05:00" and row["j"] == "web attack - xss" and row["k"] == "2023-11-14 22:13:20"


def test_survival_edges(spark):
    rows = spark.createDataFrame([(3, False, "a"), (5, False, "a"), (2, True, "b"), (2, True, "b")], "duration long, event boolean, grp string")
    curve = scores.kaplan_meier(rows).collect()
    assert [(r["grp"], r["time"], r["survival"]) for r in curve] == [("b", 2, 0.0)]


def test_bootstrap_holds_the_mean(spark):
    rows = spark.range(2000).select("id", (F.col("id") % 7).cast("double").alias("x"))
    row = scores.bootstrap(rows, F.col("x"), F.lit(1.0), 200).first()
    mean = rows.agg(F.avg(F.col("x") - 1)).first()[0]
    assert row["low"] < mean < row["high"] and row["high"] - row["low"] < 0.5
