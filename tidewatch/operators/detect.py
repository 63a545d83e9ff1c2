"""Detectors over window states: history scores, rules, findings and deployment baselines.

States are one row a window, so frames by scenario run on them and never on raw events; edge and entity lookbacks are
lags by (scenario, src, dst), which spreads them by edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import band, confidence, severity

KEY = ["scenario", "k"]
# The rules' thresholds and bands.
MIN_HISTORY, Z_SCALE, LOOKBACK, FALLBACK_CAP = 3, 6.0, 5, 0.5
ALERT_AT = {
    "ddos": 0.80, "reconnaissance": 0.80, "credential_abuse": 0.70, "lateral_movement": 0.70, "command_and_control": 0.80,
    "exfiltration": 0.80, "insider_threat": 0.70, "phishing": 0.60, "malware_activity": 0.60, "entropy_anomaly": 0.80,
}
TECHNIQUES = {
    "ddos": "T1498", "reconnaissance": "T1046", "credential_abuse": "T1110", "lateral_movement": "T1021", "command_and_control": "T1071",
    "exfiltration": "T1048", "insider_threat": "T1078", "phishing": "T1566", "malware_activity": "T1059", "entropy_anomaly": "T1046",
}


def prior(scenario: str = "scenario", order: str = "idx") -> Window:
    return Window.partitionBy(scenario).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def z_score(value: Column, over: Window) -> Column:
    """Against all earlier states: 0 below MIN_HISTORY; without spread 0 if equal, else Z_SCALE; null history values count as 0."""
    v = F.coalesce(value, F.lit(0.0))
    n, low, high = F.count(v).over(over), F.min(v).over(over), F.max(v).over(over)
    flat = F.when(v == low, F.lit(0.0)).otherwise(F.lit(Z_SCALE))
    return F.when(n < MIN_HISTORY, F.lit(0.0)).when(low == high, flat).otherwise((v - F.avg(v).over(over)) / F.stddev_pop(v).over(over))


def seen_edges(edge_rows: DataFrame, states: DataFrame, lookback: int = LOOKBACK) -> DataFrame:
    """edge rows with idx, and known: the edge was in one of the ``lookback`` emitted states before."""
    placed = edge_rows.join(states.select(*KEY, "idx"), KEY)
    last = F.lag("idx").over(Window.partitionBy("scenario", "src", "dst").orderBy("idx"))
    return placed.withColumn("known", F.coalesce(F.col("idx") - last <= lookback, F.lit(False)))


def fresh_entities(entity_rows: DataFrame, states: DataFrame) -> DataFrame:
    """entity rows with fresh: never seen in an earlier state of the scenario."""
    placed = entity_rows.join(states.select(*KEY, "idx"), KEY)
    return placed.withColumn("fresh", F.lag("idx").over(Window.partitionBy("scenario", "entity").orderBy("idx")).isNull())


def known_edge_rates(edges: DataFrame, seconds: float) -> DataFrame:
    """Bytes a second on known edges of each state; null while history is short."""
    rows = edges.groupBy(*KEY, "idx").agg(F.sum(F.when(F.col("known"), F.col("bytes")).otherwise(0.0)).alias("known_bytes"), F.count_if("known").alias("known_edges"), F.count_if(~F.col("known")).alias("new_edges"))
    return rows.withColumn("rate", F.when(F.col("idx") >= MIN_HISTORY, F.col("known_bytes") / seconds))


def fit_baseline(rates: DataFrame) -> DataFrame:
    """One row: median and median absolute deviation of a reference period's rates, and how many."""
    middle = rates.where("rate is not null").agg(F.median("rate").alias("median"), F.count("rate").alias("samples"))
    spread = rates.where("rate is not null").join(F.broadcast(middle)).agg(F.median(F.abs(F.col("rate") - F.col("median"))).alias("mad"))
    return middle.join(spread)


def baseline_score(rate: Column, median: Column, mad: Column, warn: float = 3.0, alert: float = 6.0) -> Column:
    """0 up to warn robust sigmas over the reference median, 1 from alert on; without spread anything above it is 1."""
    sigma = F.when(mad <= 0, F.when(rate <= median, F.lit(0.0)).otherwise(F.lit(alert))).otherwise(0.6745 * (rate - median) / mad)
    return band(sigma, warn, alert)


def ioc_hits(entity_rows: DataFrame, feed: DataFrame) -> DataFrame:
    """(scenario, k, matches, first_type): feed indicators among a window's entities; the type is the first match's by name."""
    hits = entity_rows.join(feed.select(F.col("indicator"), "list_type"), F.col("entity") == F.col("indicator"))
    return hits.groupBy(*KEY).agg(F.count_distinct("entity").alias("matches"), F.min_by("list_type", "entity").alias("first_type"))


def probabilities(states: DataFrame, edges: DataFrame, hits: DataFrame, seconds: float) -> DataFrame:
    """states with one p_<detector> column for each rule, in one pass over the history frame."""
    over, zero = prior(), F.lit(0.0)
    flows, every = F.col("flow_count").cast("double"), F.col("event_count").cast("double")
    z_flow, z_byte = z_score(flows / seconds, over), z_score(F.col("bytes") / seconds, over)
    z_total, z_bits = z_score(F.col("bytes"), over), z_score(F.col("edge_entropy"), over)
    rates = known_edge_rates(edges, seconds).drop("idx")
    rows = states.join(rates, KEY, "left").join(hits, KEY, "left").withColumns({"z_rate": F.greatest(z_flow, z_byte), "z_total": z_total, "z_bits": z_bits})
    cold, hit = F.col("idx") < MIN_HISTORY, F.col("matches").isNotNull()
    floor = band(F.col("bytes"), 75_000.0, 150_000.0)
    spike = F.least(F.lit(1.0), F.greatest(zero, F.col("z_total")) / 10)
    exfil = F.when(cold, F.least(F.lit(FALLBACK_CAP), F.greatest(spike, floor))).otherwise(spike)
    insider = F.least(F.lit(0.9), F.greatest(zero, F.col("z_total")) / Z_SCALE)
    return rows.withColumns({
        "p_ddos": F.least(F.lit(0.95), F.greatest(zero, F.col("z_rate")) / Z_SCALE),
        "p_reconnaissance": band(F.least(F.lit(1.0), F.coalesce(F.col("rst_count"), zero) / F.greatest(F.lit(1.0), flows)), 0.10, 0.30),
        "p_credential_abuse": band(F.coalesce(F.col("failed_auth"), zero) * flows * 60.0 / seconds, 1.0, 2.0),
        "p_lateral_movement": F.coalesce(band(F.col("rate"), 750.0, 900.0), zero),
        "p_command_and_control": F.when(hit, F.lit(0.85)).otherwise(F.coalesce(band(F.col("beacon"), 0.30, 0.60), zero)),
        "p_exfiltration": F.when(hit, F.greatest(exfil, F.lit(0.9))).otherwise(exfil),
        "p_insider_threat": F.when(cold, F.least(F.lit(FALLBACK_CAP), insider)).otherwise(insider),
        "p_phishing": F.coalesce(F.greatest(band(F.col("domain_length"), 25.0, 45.0), band(F.coalesce(F.col("tunnel"), zero), 0.10, 0.30)), zero),
        "p_malware_activity": F.coalesce(band(F.col("execs") * every, 2.0, 5.0), zero),
        "p_entropy_anomaly": F.least(F.lit(0.9), F.abs(F.col("z_bits")) / 4.8),
    })


def findings(scored: DataFrame) -> DataFrame:
    """A row per window and detector: probability to three digits; bands and alert from the unrounded value."""
    each = F.array(*[F.struct(F.lit(n).alias("attack_type"), F.lit(TECHNIQUES[n]).alias("technique"), F.col(f"p_{n}").alias("p"), F.lit(at).alias("at")) for n, at in ALERT_AT.items()])
    rows = scored.select(*KEY, "idx", F.explode(each).alias("x"))
    p = F.col("x.p")
    kind = F.when(F.col("x.attack_type") == "entropy_anomaly", "reconnaissance").otherwise(F.col("x.attack_type")).alias("attack_type")
    return rows.select(*KEY, "idx", F.col("x.attack_type").alias("detector"), kind, "x.technique", F.bround(p, 3).alias("probability"), severity(p).alias("severity"), confidence(p).alias("confidence"), (p >= F.col("x.at")).alias("is_alert"))


def near(value: Column, digits: int) -> Column:
    """Half-even rounding, after noise beyond six digits is taken off."""
    return F.bround(F.round(value.cast("double"), 6), digits)


def evidence(scored: DataFrame, seconds: float) -> DataFrame:
    """(scenario, k, idx, detector, name, observed): what each finding rests on, at most four rows a finding.

    ``scored`` comes from probabilities, with ``start``, the window's start in micros. A rule whose telemetry is absent
    has no row; the deviation rows appear only where they say something.
    """
    zero = F.lit(0.0)
    flows, hit, hour = F.col("flow_count").cast("double"), F.col("matches").isNotNull(), F.floor(F.col("start") / 3_600_000_000) % 24
    held = {
        "ddos": [("flows_per_second", near(flows / seconds, 2), None), ("bytes_per_second", near(F.col("bytes") / seconds, 0), F.col("z_rate") >= Z_SCALE / 2)],
        "reconnaissance": [
            ("rst_probe_ratio", near(F.least(F.lit(1.0), F.coalesce(F.col("rst_count"), zero) / F.greatest(F.lit(1.0), flows)), 3), None),
            ("low_byte_probes", near(F.col("probe_share"), 3), None), ("max_source_fanout", F.col("max_fanout"), None),
        ],
        "credential_abuse": [("failed_auth_per_min", near(F.coalesce(F.col("failed_auth"), zero) * flows * 60 / seconds, 2), None)],
        "lateral_movement": [
            ("known_internal_edges", F.col("known_edges"), None), ("known_edge_bytes", near(F.col("known_bytes"), 0), None),
            ("known_edge_bytes_per_sec", near(F.col("known_bytes") / seconds, 1), None), ("new_internal_edges", F.col("new_edges"), None),
        ],
        "command_and_control": [("intel_matches", F.col("matches"), hit), ("c2_beacon_score", near(F.col("beacon"), 3), ~hit & F.col("beacon").isNotNull())],
        "exfiltration": [("window_bytes", near(F.col("bytes"), 0), None), ("bytes_zscore", near(F.col("z_total"), 2), F.abs("z_total") > 1e-9), ("intel_matches", F.col("matches"), hit)],
        "insider_threat": [("bytes_zscore", near(F.col("z_total"), 2), None), ("window_hour_utc", hour, None)],
        "phishing": [(name, near(F.coalesce(F.col(c), zero), digits), F.col("domain_length").isNotNull() | F.col("tunnel").isNotNull()) for name, c, digits in (("mean_domain_length", "domain_length", 1), ("tunnel_marker_share", "tunnel", 3))],
        "malware_activity": [("process_executions", near(F.col("execs") * F.col("event_count"), 0), F.col("execs").isNotNull())],
        "entropy_anomaly": [("byte_entropy", near(F.coalesce(F.col("edge_entropy"), zero), 3), None), ("entropy_deviation", near(F.col("z_bits"), 2), F.abs("z_bits") > 1.5)],
    }
    each = []
    for detector, items in held.items():
        for name, value, when in items:
            item = F.struct(F.lit(detector).alias("detector"), F.lit(name).alias("name"), value.cast("double").alias("observed"))
            each.append(item if when is None else F.when(when, item))
    return scored.select(*KEY, "idx", F.explode(F.array_compact(F.array(*each))).alias("x")).select(*KEY, "idx", "x.*")


#: What each warning says about a finding.
WARNINGS = {
    "short_history": "fewer earlier windows than a baseline needs; scored with care", "flood_kind_unknown": "flow rates don't tell which kind of flood it is",
    "flood_unvalidated": "no flood occurs in the validation data", "window_too_long": "windows over ten seconds blur floods", "failures_not_by_edge": "failed logins are known in total only",
    "no_known_edges": "too little history to know edges; scored zero", "no_deployment_baseline": "no reference period fitted; the absolute band is used", "volume_floor": "absolute volume used, score held under the alert",
    "listed_host": "raised because a listed host takes part", "list_only": "a list entry isn't proof of beaconing", "feed_stale": "the feed is older than a day", "needs_identity_data": "confirm with identity and access data",
    "no_dns_data": "no DNS features; rule is off", "dns_only": "confirm with mail data", "no_beacon_data": "no DNS or TLS metadata; rule is off", "sensor_score": "the score is the sensor's own",
    "no_process_data": "no endpoint data; rule is off", "burst_only": "confirm with file reputation",
}


def warnings(scored: DataFrame, seconds: float, baseline: bool = False, stale: bool = False) -> DataFrame:
    """(scenario, k, idx, detector, warning): the reservations of each finding, as keys of WARNINGS.

    ``baseline`` says whether the deployment's reference is fitted, ``stale`` whether the feed is older than a day.
    """
    cold, hit, yes = F.col("idx") < MIN_HISTORY, F.col("matches").isNotNull(), F.lit(True)
    dns = F.col("domain_length").isNotNull() | F.col("tunnel").isNotNull()
    held = {
        "ddos": {"flood_kind_unknown": F.col("p_ddos") > 1e-9, "flood_unvalidated": F.col("p_ddos") >= ALERT_AT["ddos"], "window_too_long": F.lit(seconds > 10)},
        "reconnaissance": {}, "entropy_anomaly": {},
        "credential_abuse": {"failures_not_by_edge": F.coalesce(F.col("failed_auth") * F.col("flow_count") > 0, F.lit(False))},
        "lateral_movement": {"no_known_edges": cold, "no_deployment_baseline": ~cold & F.lit(not baseline)},
        "command_and_control": {"list_only": hit, "feed_stale": hit & F.lit(stale), "no_beacon_data": ~hit & F.col("beacon").isNull(), "sensor_score": ~hit & F.col("beacon").isNotNull()},
        "exfiltration": {"volume_floor": cold, "listed_host": hit, "feed_stale": hit & F.lit(stale)},
        "insider_threat": {"needs_identity_data": yes}, "phishing": {"no_dns_data": ~dns, "dns_only": dns},
        "malware_activity": {"no_process_data": F.col("execs").isNull(), "burst_only": F.col("execs").isNotNull()},
    }
    each = [F.when(when, F.struct(F.lit(d).alias("detector"), F.lit(w).alias("warning"))) for d, items in held.items() for w, when in {**items, "short_history": cold}.items()]
    return scored.select(*KEY, "idx", F.explode(F.array_compact(F.array(*each))).alias("x")).select(*KEY, "idx", "x.*")


def affected_assets(fresh: DataFrame, registry: DataFrame) -> DataFrame:
    """(scenario, k, asset, fresh, critical): entities new in a window, and registered critical ones that take part.

    A row an asset, never a list, so a window with many new hosts stays spread. ``fresh`` comes from fresh_entities;
    an asset registered twice counts once.
    """
    named = registry.where("criticality = 'critical'").select("asset_id").distinct()
    rows = fresh.join(named, F.col("entity") == F.col("asset_id"), "left").withColumn("critical", F.col("asset_id").isNotNull())
    return rows.where(F.col("fresh") | F.col("critical")).select(*KEY, F.col("entity").alias("asset"), "fresh", "critical")


def lateral_by_baseline(rates: DataFrame, fitted: DataFrame) -> DataFrame:
    """The lateral-movement finding where the deployment's reference is fitted; ``fitted`` is one row, from fit_baseline.

    Short history scores zero without a sigma; so does a reference without samples.
    """
    rows = rates.join(F.broadcast(fitted))
    sigma = F.when(F.col("mad") <= 0, F.when(F.col("rate") <= F.col("median"), 0.0).otherwise(6.0)).otherwise(0.6745 * (F.col("rate") - F.col("median")) / F.col("mad"))
    p = F.coalesce(baseline_score(F.col("rate"), F.col("median"), F.col("mad")), F.lit(0.0))
    return rows.select(*KEY, "idx", F.bround(p, 3).alias("probability"), severity(p).alias("severity"), confidence(p).alias("confidence"), (p >= ALERT_AT["lateral_movement"]).alias("is_alert"), near(sigma, 2).alias("sigma"))


def scorecard(found: DataFrame, labels: DataFrame, stage_of: dict[str, str]) -> DataFrame:
    """Counts, precision, recall and F1 of each rule against the window's stage; null for rules whose stage never occurs."""
    pairs = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(s).alias("s")) for t, s in stage_of.items()])
    rows = found.join(labels.select(*KEY, "stage"), KEY).withColumn("m", F.get(F.filter(pairs, lambda x: x["t"] == F.col("detector")), 0)["s"]).where("m is not null")
    hit = F.col("stage") == F.col("m")
    out = rows.groupBy("detector").agg(F.count_if(F.col("is_alert") & hit).alias("tp"), F.count_if(F.col("is_alert") & ~hit).alias("fp"), F.count_if(~F.col("is_alert") & hit).alias("fn"), F.count_if(~F.col("is_alert") & ~hit).alias("tn"))
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp")))
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn")))
    seen = F.col("tp") + F.col("fn") > 0
    return out.select("detector", "tp", "fp", "fn", "tn", F.when(seen, precision).alias("precision"), F.when(seen, recall).alias("recall"), F.when(seen & (2 * F.col("tp") + F.col("fp") + F.col("fn") > 0), 2 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))).alias("f1"))


def map_stage(states: DataFrame, probability: Column) -> DataFrame:
    """The stage hypothesis of each window: of the rules that fire, the one of highest confidence, then highest stage."""
    rules = [
        ("Reconnaissance", 0, F.col("failed_auth") > 0, F.least(F.lit(0.95), 0.6 + 0.1 * F.col("failed_auth"))),
        ("Initial Access", 1, F.col("event_count") > 20, F.least(F.lit(0.9), 0.5 + F.col("event_count") / 100)),
        ("Lateral Movement", 2, F.col("bytes") > 10_000, F.least(F.lit(0.95), 0.65 + F.col("bytes") / 200_000)),
        ("Command and Control", 3, F.col("retransmission") > 2, F.least(F.lit(0.95), 0.6 + 0.05 * F.col("retransmission"))),
        ("Exfiltration", 4, (F.col("bytes") > 100_000) & (F.col("external_count") > 0), F.least(F.lit(0.95), 0.7 + F.col("bytes") / 400_000)),
    ]
    fired = F.array_compact(F.array(*[F.when(when, F.struct(c.alias("c"), F.lit(i).alias("i"), F.lit(n).alias("stage"))) for n, i, when, c in rules]))
    best = F.array_max(fired)
    c = best["c"]
    label = F.when(c >= 0.8, "high").when(c >= 0.6, "medium").when(c.isNotNull(), "low").otherwise("unknown")
    return states.select(*KEY, "idx", F.coalesce(best["stage"], F.lit("Unknown")).alias("stage"), F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * probability + 0.5 * c)), F.lit(0.0)).alias("probability"), label.alias("confidence"), F.size(fired).alias("rules"))


def adaptive_entropy(states: DataFrame, threshold: float = 3.8) -> DataFrame:
    """Entropy against its own history: |H - mean| / 3, or (H - threshold) / 2 without one; between 0 and 1."""
    mean = F.avg("edge_entropy").over(prior())
    raw = F.when(mean.isNull(), (F.col("edge_entropy") - threshold) / 2).otherwise(F.abs(F.col("edge_entropy") - mean) / 3)
    return states.select(*KEY, "idx", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)).alias("score"))


def next_techniques(alerts: DataFrame, transitions: DataFrame) -> DataFrame:
    """For windows with two alerts or more: recency-weighted next techniques, as shares of the greatest.

    alerts has an ``at`` column, the place of a finding from the last one back (0 is the last).
    """
    voted = alerts.join(transitions, F.col("attack_type") == F.col("current")).groupBy(*KEY, "next").agg(F.sum(F.col("p") / (F.col("at") + 1)).alias("votes"))
    several = alerts.groupBy(*KEY).agg(F.count("*").alias("n")).where("n >= 2")
    top = F.max("votes").over(Window.partitionBy(*KEY))
    return voted.join(several, KEY).select(*KEY, "next", (F.col("votes") / top).alias("probability"))


def alert_places(found: DataFrame) -> DataFrame:
    """Alerts with ``at``, their place from the last rule back in each window (0 is the last); the rules stand in ALERT_AT's order."""
    place = F.array_position(F.array(*[F.lit(d) for d in ALERT_AT]), F.col("detector"))
    return found.where("is_alert").withColumn("at", F.row_number().over(Window.partitionBy(*KEY).orderBy(place.desc())) - 1)


def sequence_findings(placed: DataFrame, transitions: DataFrame) -> DataFrame:
    """The finding of the next technique in windows with two alerts or more, as findings are, plus ``transition``.

    ``placed`` comes from alert_places; transitions are (current, next, p, place), place their order. Of techniques with
    equal votes that named first counts, from the last alert back. The greatest vote is the unit, so the chosen one has
    probability 1. transition is the chance of the step from the last alert, 0 if that step isn't known.
    """
    voted = placed.join(transitions, F.col("attack_type") == F.col("current"))
    sums = voted.groupBy(*KEY, "idx", "next").agg(F.round(F.sum(F.col("p") / (F.col("at") + 1)), 9).alias("votes"), F.min(F.struct("at", "place")).alias("first"), F.max(F.when(F.col("at") == 0, F.col("p"))).alias("last_p"))
    best = F.max_by(F.struct("next", "last_p"), F.struct("votes", -F.col("first.at"), -F.col("first.place")))
    several = placed.groupBy(*KEY).agg(F.count("*").alias("n")).where("n >= 2").select(*KEY)
    rows = sums.groupBy(*KEY, "idx").agg(best.alias("b")).join(several, KEY)
    return rows.select(*KEY, "idx", F.lit("sequence_prediction").alias("detector"), F.col("b.next").alias("attack_type"), F.lit("sequence-prediction").alias("technique"), F.lit(1.0).alias("probability"), F.lit("critical").alias("severity"), F.lit("high").alias("confidence"), F.lit(True).alias("is_alert"), F.coalesce("b.last_p", F.lit(0.0)).alias("transition"))
