"""Labelled states: future labels, samples, splits, walk-forward replay and its summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import FORBIDDEN
from ..plans.tables import stored


def by_state(scenario: str = "scenario") -> Window:
    return Window.partitionBy(scenario).orderBy("idx")


def future_label(states: DataFrame, horizon: int) -> DataFrame:
    """Stage and infiltration of the state ``horizon`` places on, in the same scenario only."""
    ahead = F.lead(F.struct("idx", "stage", "infiltration"), horizon).over(by_state())
    return states.withColumn("f", ahead).where("f is not null").select("scenario", "idx", F.col("f.idx").alias("target_idx"), F.col("f.stage").alias("target_stage"), F.col("f.infiltration").alias("target"))


def samples(states: DataFrame, length: int, horizon: int) -> DataFrame:
    """Input keys of the last ``length`` states and the label ``horizon`` on; only whole ones."""
    back = by_state().rowsBetween(-(length - 1), 0)
    rows = states.select("scenario", "idx", F.collect_list(F.concat_ws(":", "scenario", "idx")).over(back).alias("inputs"), F.lead("infiltration", horizon).over(by_state()).alias("target"))
    return rows.where((F.size("inputs") == length) & F.col("target").isNotNull())


def stage_sequences(states: DataFrame, length: int, vocabulary: list[str]) -> DataFrame:
    """All runs of ``length`` stages whose stages are in the vocabulary."""
    back = by_state().rowsBetween(-(length - 1), 0)
    rows = states.select("scenario", "idx", F.collect_list("stage").over(back).alias("stages"))
    return rows.where((F.size("stages") == length) & F.forall("stages", lambda s: s.isin(vocabulary)))


def draw(seed: int, key: str) -> Column:
    """A whole number from 0 to 2**60 drawn by a seeded digest of the key, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 15), 16, 10).cast("long")


def split_scenarios(scenarios: DataFrame, seed: int = 42, train: float = 0.6, validation: float = 0.2) -> DataFrame:
    """scenario and split: whole scenarios in the order of a seeded draw, with at least one in each split where there are three."""
    from .scores import running

    drawn = stored(scenarios.select("scenario").distinct().withColumn("draw", draw(seed, "scenario")).withColumn("one", F.lit(1)), "drawn")
    n = drawn.count()
    a = max(1, min(int(n * train), n - 2))
    b = max(a + 1, min(int(n * (train + validation)), n - 1))
    r = F.col("one_before") + 1
    return running(drawn, "draw", ["one"]).select("scenario", F.when(r <= a, "train").when(r <= b, "validation").otherwise("test").alias("split"))


def stratified_split(scenarios: DataFrame, seed: int = 42) -> DataFrame:
    """scenario and split: in turns inside each stage, in the order of a seeded draw."""
    from .scores import running

    drawn = stored(scenarios.select("scenario", "stage").withColumn("draw", draw(seed, "scenario")).withColumn("one", F.lit(1)), "drawn")
    turn = F.col("one_before") % 3
    return running(drawn, "draw", ["one"], ["stage"]).select("scenario", "stage", F.when(turn == 0, "train").when(turn == 1, "validation").otherwise("test").alias("split"))


def split_audit(sample_rows: DataFrame, splits: DataFrame) -> DataFrame:
    """Samples of each split, scenarios in more than one split, states that samples of more than one split read, and samples without one."""
    placed = sample_rows.join(splits, "scenario", "left")
    doubled = splits.groupBy("scenario").agg(F.count_distinct("split").alias("n")).where("n > 1").agg(F.count("*").alias("in_two_splits"))
    keys = placed.where("split is not null").select("split", F.explode("inputs").alias("key")).groupBy("key").agg(F.count_distinct("split").alias("n"))
    shared = keys.where("n > 1").agg(F.count("*").alias("shared_states"))
    counts = placed.groupBy(F.coalesce("split", F.lit("unassigned")).alias("split")).agg(F.count("*").alias("samples"), F.count_if("target").alias("positive"))
    return counts.join(doubled).join(shared)


def replay(scored: DataFrame, horizon: int, threshold: float, min_history: int = 2) -> DataFrame:
    """Each scored state (p, stage, infiltration) with what came true, its phase of the attack, and its lead credit.

    Only states with ``horizon`` states after them and ``min_history`` up to them are walked. A forecast crosses in its
    first window, so the lead is the place of the first true window among the following ones, from 0.
    """
    over, whole = by_state(), Window.partitionBy("scenario")
    ahead = over.rowsBetween(1, horizon)
    begun = F.when(F.col("infiltration"), F.col("idx"))
    rows = scored.withColumns({
        "crossed": F.col("p") >= threshold, "realized": F.max("infiltration").over(ahead), "realized_stage": F.lead("stage", horizon).over(over),
        "onset": F.min(begun).over(whole), "first": F.min(begun).over(ahead), "observed": F.count("*").over(ahead),
    })
    rows = rows.where((F.col("idx") >= min_history - 1) & (F.col("observed") == horizon))
    phase = F.when(F.col("onset").isNull(), "NO_ATTACK").when(F.col("idx") < F.col("onset"), "PRE_ONSET").when(F.col("idx") < F.col("onset") + horizon, "DURING_ATTACK").otherwise("POST_ATTACK")
    back = Window.partitionBy("scenario").orderBy(F.col("idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({
        "phase": phase, "lead": F.when(F.col("crossed") & F.col("realized"), F.col("first") - F.col("idx") - 1),
        "next_crossing": F.min(F.when(F.col("crossed"), F.col("idx"))).over(back),
    }).drop("observed", "first")


def replay_summary(rows: DataFrame) -> DataFrame:
    """Per scenario: replayed states, crossings, realised ones, hits, false early calls, crossings by phase, accuracy and median lead."""
    crossed, realized = F.col("crossed"), F.col("realized")
    return rows.groupBy("scenario").agg(
        F.count("*").alias("states"), F.count_if(crossed).alias("crossings"), F.count_if(realized).alias("realized_onsets"), F.count_if(crossed & realized).alias("hits"),
        F.count_if(crossed & ~realized).alias("false_early"), F.avg((crossed == realized).cast("double")).alias("accuracy"), F.median("lead").alias("median_lead"),
        F.median(F.when(F.col("phase") == "PRE_ONSET", F.col("lead"))).alias("median_pre_onset_lead"),
        *[F.count_if(crossed & (F.col("phase") == p)).alias(n) for n, p in (("pre_onset_warnings", "PRE_ONSET"), ("during_attack_detections", "DURING_ATTACK"), ("post_attack_predictions", "POST_ATTACK"))],
        F.min("onset").alias("onset"),
    )


def survival_records(rows: DataFrame) -> DataFrame:
    """From each replayed state before a realised attack: states to the next crossing, censored after the scenario's last replayed one."""
    last = F.max("idx").over(Window.partitionBy("scenario"))
    event = F.col("next_crossing").isNotNull()
    duration = F.when(event, F.col("next_crossing") - F.col("idx")).otherwise(F.col("last") - F.col("idx") + 1)
    return rows.withColumn("last", last).where("realized").select("scenario", "idx", duration.alias("duration"), event.alias("event"))


def expected_against_observed(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Per scenario: hit, missed and unexpected types, and a verdict."""
    both = expected.groupBy("scenario").agg(F.array_sort(F.collect_set("attack_type")).alias("e")).join(observed.groupBy("scenario").agg(F.array_sort(F.collect_set("attack_type")).alias("o")), "scenario", "full_outer")
    none = F.array().cast("array<string>")
    e, o = F.coalesce("e", none), F.coalesce("o", none)
    missed = F.array_except(e, o)
    verdict = F.when(F.size(e) == 0, "NO-CLAIM").when(F.size(missed) == 0, "HIT").otherwise("MISS")
    return both.select("scenario", F.array_join(F.array_sort(F.array_intersect(e, o)), ",").alias("hit"), F.array_join(F.array_sort(missed), ",").alias("missed"), F.array_join(F.array_sort(F.array_except(o, e)), ",").alias("unexpected"), verdict.alias("verdict"))


def eligible(features: list[str]) -> list[str]:
    """The features without those that tell the answer."""
    return [f for f in features if f not in FORBIDDEN]


def standardise(rows: DataFrame, features: list[str], training: Column) -> DataFrame:
    """(feature, mean, scale) over the training rows: nulls as 0, population spread, scale 1 where there is none."""
    features = eligible(features)
    stats = rows.where(training).agg(*[x for f in features for x in (F.avg(F.coalesce(f, F.lit(0.0))).alias(f"m_{f}"), F.stddev_pop(F.coalesce(f, F.lit(0.0))).alias(f"s_{f}"))])
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"m_{f}").alias("mean"), F.when(F.col(f"s_{f}") == 0, 1.0).otherwise(F.col(f"s_{f}")).alias("scale")) for f in features])
    return stats.select(F.explode(each).alias("x")).select("x.*")


def vectors(rows: DataFrame, schema: DataFrame, features: list[str], keys: list[str]) -> DataFrame:
    """Long form of standardised features: keys, feature, value, z."""
    each = F.array(*[F.struct(F.lit(f).alias("feature"), F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias("value")) for f in features])
    long = rows.select(*keys, F.explode(each).alias("x")).select(*keys, "x.feature", "x.value")
    return long.join(schema, "feature").withColumn("z", (F.col("value") - F.col("mean")) / F.col("scale"))


def top_drivers(long: DataFrame, weights: DataFrame, keys: list[str], k: int = 5) -> DataFrame:
    """The k features of the greatest |z x weight| of each row (ties by name), with the signed part."""
    part = long.join(weights, "feature").withColumn("contribution", F.col("z") * F.col("weight"))
    order = Window.partitionBy(*keys).orderBy(F.round(F.abs("contribution"), 9).desc(), "feature")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*keys, "feature", "contribution", "rank")


def timeline(rows: DataFrame, horizons: int) -> DataFrame:
    """A row per horizon: the probability decayed toward one half."""
    from ..functions.scalars import decay

    long = rows.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizons))))
    return long.withColumn("forecast", decay(F.col("p"), F.col("horizon")))


def supporting(states: DataFrame, entities: DataFrame, back: int = 3, most: int = 10) -> DataFrame:
    """states (scenario, idx) with the first ``most`` distinct entities of the last ``back`` states, by state, then name.

    Of each state at most back x most entities can matter (those of the earlier states come first, and may be its own too), so
    arrays are bounded however many hosts a window has.
    """
    order = Window.partitionBy("scenario", "idx").orderBy("entity")
    own = entities.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= back * most)
    own = own.groupBy("scenario", "idx").agg(F.array_sort(F.collect_list("entity")).alias("own"))
    over = by_state().rowsBetween(-(back - 1), 0)
    none = F.array().cast("array<string>")
    rows = states.join(own, ["scenario", "idx"], "left").withColumn("own", F.coalesce("own", none))
    return rows.select("scenario", "idx", F.slice(F.array_distinct(F.flatten(F.collect_list("own").over(over))), 1, most).alias("entities"))
