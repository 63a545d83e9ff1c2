"""Correlation of alerts into incidents, risk, kill-chain likelihood and transition models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import risk_level
from ..plans.tables import shared_folder, stored

# Weights, orders, advice and prior transition tables.
CRITICALITY = {"low": 0.25, "medium": 0.50, "high": 0.75, "critical": 1.0}
SEVERITY = {"info": 0.0, "low": 0.25, "medium": 0.50, "high": 0.75, "critical": 1.0}
STEPS = {
    "ddos": 0, "reconnaissance": 0, "phishing": 0, "malware_activity": 1, "credential_abuse": 1,
    "insider_threat": 2, "lateral_movement": 2, "command_and_control": 3, "exfiltration": 3,
}
ADVICE = {
    "reconnaissance": "Review firewall logs for the scanning source",
    "credential_abuse": "Check auth logs for targeted accounts; disable suspect accounts pending review",
    "lateral_movement": "Isolate affected internal host; restrict SMB/RDP to the targeted server",
    "exfiltration": "Preserve evidence; review egress logs for the destination",
    "ddos": "Engage upstream scrubbing; rate-limit the targeted service",
    "command_and_control": "Review DNS/proxy logs; hunt the beacon pattern estate-wide",
    "insider_threat": "Review the account's access history with HR; do not confront before evidence is preserved",
    "phishing": "Search mailboxes and proxy logs for the URL/sender; review click events",
    "malware_activity": "Isolate the endpoint; collect process lineage and file hashes",
}
LAST_ADVICE = "Preserve evidence; all actions analyst-approved"
PRIOR_TRANSITIONS = [
    ("reconnaissance", "credential_abuse", 0.72), ("reconnaissance", "lateral_movement", 0.45), ("reconnaissance", "command_and_control", 0.30),
    ("credential_abuse", "lateral_movement", 0.85), ("credential_abuse", "command_and_control", 0.55), ("credential_abuse", "exfiltration", 0.35),
    ("lateral_movement", "exfiltration", 0.70), ("lateral_movement", "command_and_control", 0.60), ("lateral_movement", "malware_activity", 0.40),
    ("command_and_control", "exfiltration", 0.80), ("command_and_control", "malware_activity", 0.50), ("exfiltration", "command_and_control", 0.25),
    ("ddos", "reconnaissance", 0.30), ("ddos", "credential_abuse", 0.20), ("insider_threat", "exfiltration", 0.65),
    ("insider_threat", "lateral_movement", 0.45), ("malware_activity", "lateral_movement", 0.55), ("malware_activity", "exfiltration", 0.40),
]
STARTS = [("reconnaissance", 0.35), ("ddos", 0.15), ("phishing", 0.20), ("credential_abuse", 0.15), ("malware_activity", 0.10), ("insider_threat", 0.05)]
NEXT_TRANSITIONS = [
    ("reconnaissance", "credential_abuse", 0.85), ("reconnaissance", "lateral_movement", 0.15),
    ("credential_abuse", "lateral_movement", 0.70), ("credential_abuse", "command_and_control", 0.20), ("credential_abuse", "exfiltration", 0.10),
    ("lateral_movement", "command_and_control", 0.50), ("lateral_movement", "exfiltration", 0.35), ("lateral_movement", "insider_threat", 0.15),
    ("command_and_control", "exfiltration", 0.60), ("command_and_control", "malware_activity", 0.30), ("command_and_control", "insider_threat", 0.10),
    ("ddos", "reconnaissance", 0.30), ("ddos", "credential_abuse", 0.40), ("ddos", "lateral_movement", 0.30),
    ("exfiltration", "command_and_control", 0.20), ("exfiltration", "insider_threat", 0.30),
    ("malware_activity", "command_and_control", 0.40), ("malware_activity", "lateral_movement", 0.30), ("malware_activity", "exfiltration", 0.30),
]


def weight(name: Column, table: dict[str, float], default: float | None = None) -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(name == k, F.lit(v)).otherwise(out)
    return out


def chains(alerts: DataFrame, gap: int, key: str = "scenario") -> DataFrame:
    """alerts (start, end, probability, attack_type) with chain: a new one where the gap to the alert before exceeds ``gap``."""
    order = Window.partitionBy(key).orderBy(F.col("start"), F.col("probability").desc(), F.col("attack_type"))
    new = F.coalesce((F.col("start") - F.lag("end").over(order) > gap).cast("int"), F.lit(0))
    marked = alerts.withColumn("new", new)
    return marked.withColumn("chain", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def progression(rows: DataFrame, key: list[str]) -> DataFrame:
    """key and progression: attack types in the order first seen (ties by name)."""
    first = rows.groupBy(*key, "attack_type").agg(F.min("start").alias("s"))
    return first.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "attack_type"))), lambda x: x["attack_type"]).alias("progression"))


def incident_assets(chained: DataFrame, affected: DataFrame) -> DataFrame:
    """(scenario, chain, asset, critical): the affected assets of the windows of an incident's alerts, each once."""
    spans = chained.select("scenario", "chain", "k").distinct()
    return spans.join(affected, ["scenario", "k"]).groupBy("scenario", "chain", "asset").agg(F.max("critical").alias("critical"))


def incidents(chained: DataFrame, key: str = "scenario") -> DataFrame:
    """A row per chain: bounds, findings, types, progression, risk and its level."""
    ids = [key, "chain"]
    peak = F.max_by(F.struct("probability", "severity"), F.struct("probability", F.col("attack_type")))
    rows = chained.groupBy(*ids).agg(F.min("start").alias("first_seen"), F.max("end").alias("last_seen"), F.count("*").alias("findings"), F.count_distinct("attack_type").alias("types"), peak.alias("peak"), F.max("criticality").alias("worst"))
    base = fused_risk(F.col("peak.probability"), F.col("peak.severity"), F.col("worst"))
    bonus = F.when(F.col("findings") > 1, F.least(F.lit(0.15), 0.03 * (F.col("types") - 1))).otherwise(0.0)
    score = F.least(F.lit(1.0), F.bround(base, 3) + bonus)
    rows = rows.withColumn("risk", F.bround(score, 3)).withColumn("level", risk_level(score)).drop("peak", "worst")
    return rows.join(progression(chained, ids), ids).withColumn("incident_id", incident_id(F.col("first_seen"), key))


def incident_id(first_seen: Column, key: str, prefix: str = "INC") -> Column:
    """The name of a chain: its place among the key's chains in time, from 1, with three digits at least."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(first_seen, "chain")).cast("string")
    return F.concat(F.lit(prefix + "-"), F.when(F.length(place) < 3, F.lpad(place, 3, "0")).otherwise(place))


def fused_risk(probability: Column, severity: Column, criticality: Column) -> Column:
    """0.5 probability + 0.3 worst criticality (0.5 if unknown) + 0.2 severity weight, at most 1."""
    return F.least(F.lit(1.0), 0.5 * probability + 0.3 * F.coalesce(criticality, F.lit(0.5)) + 0.2 * weight(severity, SEVERITY, 0.0))


def recommendations(chained: DataFrame, key: str = "scenario") -> DataFrame:
    """(key, chain, step, action): advice for each type in step order, and the closing line unless evidence is named already."""
    steps = {t: float(i) for t, i in STEPS.items()}
    types = chained.where(F.col("attack_type").isin(list(ADVICE))).groupBy(key, "chain", "attack_type").agg(weight(F.col("attack_type"), steps).cast("int").alias("step"))
    action = F.lit(None)
    for t, a in ADVICE.items():
        action = F.when(F.col("attack_type") == t, a).otherwise(action)
    listed = types.select(key, "chain", "step", action.alias("action"))
    last = chained.groupBy(key, "chain").agg(F.max((F.col("attack_type") == "exfiltration").cast("int")).alias("named")).where("named = 0")
    return listed.union(last.select(key, "chain", F.lit(99).alias("step"), F.lit(LAST_ADVICE).alias("action")))


def sequence_likelihood(spark: SparkSession, sequences: DataFrame, key: list[str]) -> DataFrame:
    """key and probability of each ordered sequence (array column ``progression``) under the prior transition table."""
    starts, moves = spark.createDataFrame(STARTS, "t string, p0 double"), spark.createDataFrame(PRIOR_TRANSITIONS, "cur string, nxt string, p double")
    steps = sequences.select(*key, F.posexplode("progression").alias("i", "b"), "progression").withColumn("a", F.when(F.col("i") > 0, F.col("progression")[F.col("i") - 1])).drop("progression")
    steps = steps.join(F.broadcast(moves), (F.col("a") == F.col("cur")) & (F.col("b") == F.col("nxt")), "left").join(F.broadcast(starts), F.col("b") == F.col("t"), "left")
    log = F.log(F.when(F.col("i") == 0, F.coalesce("p0", F.lit(0.05))).otherwise(F.coalesce("p", F.lit(0.05))))
    return steps.groupBy(*key).agg(F.exp(F.sum(log)).alias("likelihood"))


def transition_model(pairs: DataFrame, smoothing: float = 0.1, min_support: int = 1) -> DataFrame:
    """(source, target, n, probability) from (source, target) pairs, smoothed over the targets seen after each source."""
    counts = pairs.groupBy("source", "target").agg(F.count("*").alias("n"))
    row = Window.partitionBy("source")
    smoothed = counts.withColumn("probability", (F.col("n") + smoothing) / (F.sum("n").over(row) + smoothing * F.count("*").over(row)))
    return smoothed.where(F.col("n") >= min_support)


def top_next(model: DataFrame, k: int = 3) -> DataFrame:
    """The k most probable targets of each source (ties by name)."""
    order = Window.partitionBy("source").orderBy(F.col("probability").desc(), "target")
    return model.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def with_fallback(model: DataFrame, prior: DataFrame, observed: DataFrame) -> DataFrame:
    """(source, target, probability, origin): the model's row where it has one for a source, else the prior table's."""
    mine = model.select("source", "target", "probability", F.lit("model").alias("origin"))
    other = prior.join(mine.select("source").distinct(), "source", "left_anti").select("source", "target", "probability", F.lit("prior").alias("origin"))
    return mine.union(other).join(observed.select("source").distinct(), "source", "left_semi")


def paths(nodes: DataFrame, links: DataFrame, starts: DataFrame) -> DataFrame:
    """Every cycle-free path from a start to a leaf, level by level: (bundle, path of node ids).

    A node's links are one row, so a level is one join and no path is grouped; finished paths are appended to one folder, so
    the plan doesn't grow with the longest path.
    """
    spark, kind = starts.sparkSession, starts.schema["bundle"].dataType.simpleString()
    ahead = stored(links.groupBy("bundle", F.col("src").alias("at")).agg(F.collect_set("dst").alias("to")), "path-links")
    now = stored(starts.select("bundle", F.array("id").alias("path")).distinct(), "paths")
    folder = shared_folder(spark, "path-ends")
    none = F.array().cast("array<string>")
    while True:
        step = now.withColumn("at", F.element_at("path", -1)).join(ahead, ["bundle", "at"], "left")
        free = F.filter(F.coalesce("to", none), lambda x: ~F.array_contains("path", x))
        step = stored(step.select("bundle", "path", free.alias("free")), "path-steps")
        step.where(F.size("free") == 0).select("bundle", "path").write.mode("append").parquet(folder)
        now = step.select("bundle", "path", F.explode("free").alias("dst")).select("bundle", F.concat("path", F.array("dst")).alias("path"))
        if not now.head(1):
            return spark.read.schema(f"bundle {kind}, path array<string>").parquet(folder)


def start_model(sequences: DataFrame) -> DataFrame:
    """(target, probability) of the first techniques of sequences (array column ``techniques``)."""
    first = sequences.where(F.size("techniques") > 0).groupBy(F.col("techniques")[0].alias("target")).agg(F.count("*").alias("n"))
    return first.join(first.agg(F.sum("n").alias("all"))).select("target", (F.col("n") / F.col("all")).alias("probability"))


def next_techniques(model: DataFrame, starts: DataFrame, prior: DataFrame, observed: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(key, target, probability, origin, rank): the k most probable next techniques of each key, ties by name.

    observed: key and last, the last technique seen, null where nothing was: then the start probabilities count. A last
    technique that the model doesn't know has the prior table's row, and one that neither knows has none.
    """
    begun = observed.where("last IS NULL").select(key).join(starts.select("target", "probability", F.lit("start").alias("origin")))
    seen = observed.where("last IS NOT NULL").select(key, F.col("last").alias("source"))
    later = seen.join(with_fallback(model, prior, seen), "source").select(key, "target", "probability", "origin")
    order = Window.partitionBy(key).orderBy(F.col("probability").desc(), "target")
    return begun.unionByName(later).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


REFS = ("start_refs", "effect_refs", "on_true_refs", "on_false_refs")
BUNDLE = "objects array<struct<id: string, type: string, technique_id: string, " + ", ".join(f"{r}: array<string>" for r in REFS) + ">>"


#: Nodes that a way passes in one scan of the bundles.
REACH = 16


def bundle_graphs(bundles: DataFrame) -> DataFrame:
    """(row, bundle, nodes, starts) of flow bundles (bundle, json), a row for each: nodes hold technique, leaf and to; starts and to are places in nodes.

    Of objects with one id the last counts. An action or operator leads to its effects, a condition to both branches; a
    reference to an id that isn't there leads nowhere, but its action is no leaf.
    """
    none = F.array().cast("array<string>")
    refs = lambda o, *names: F.concat(*[F.coalesce(o[r], none) for r in names])
    objects = bundles.select("bundle", F.from_json("json", BUNDLE)["objects"].alias("o"))
    named = F.array_sort(F.transform(F.filter("o", lambda o: o["id"].isNotNull()), lambda o, i: F.struct(o["id"].alias("id"), i.alias("at"), o.alias("o"))))
    sorted_ = objects.select("bundle", F.flatten(F.transform(F.filter("o", lambda o: o["type"] == "attack-flow"), lambda o: refs(o, "start_refs"))).alias("first"), named.alias("s"))
    last = F.filter("s", lambda x, i: ~F.get(F.col("s"), i + 1)["id"].eqNullSafe(x["id"]) & x["o"]["type"].isin("attack-action", "attack-condition", "attack-operator"))
    kept = sorted_.select("bundle", "first", F.transform(last, lambda x: x["o"]).alias("o"))
    kept = kept.select("bundle", "first", "o", F.transform("o", lambda o: o["id"]).alias("ids"))
    places = lambda to: F.filter(F.transform(to, lambda x: F.array_position(F.col("ids"), x).cast("int") - 1), lambda i: i >= 0)
    out = lambda o: F.when(o["type"] == "attack-condition", refs(o, "on_true_refs", "on_false_refs")).otherwise(refs(o, "effect_refs"))
    action = lambda o: o["type"] == "attack-action"
    technique = lambda o: F.when(action(o) & (o["technique_id"] != ""), o["technique_id"])
    leaf = lambda o: action(o) & (F.size(refs(o, "effect_refs")) == 0)
    nodes = F.transform("o", lambda o: F.struct(technique(o).alias("technique"), leaf(o).alias("leaf"), places(out(o)).alias("to")))
    graphs = kept.select(F.monotonically_increasing_id().alias("row"), "bundle", nodes.alias("nodes"), places(F.col("first")).alias("starts"))
    return stored(graphs.where(F.size("starts") > 0), "bundle-graphs")


def technique_paths(bundles: DataFrame) -> DataFrame:
    """(bundle, techniques): the techniques on every way from a start to a leaf action that passes no node twice.

    Actions without a technique are passed; a way without any technique, or one that ends in a cycle or an open branch,
    gives nothing. A bundle's nodes stay in its row while its ways pass up to REACH of them, so these steps need no shuffle
    and no table; a way is a row of node places. Only ways that are longer meet their bundle again, in the next scan, and
    finished ones are one table a scan.
    """
    graphs = bundle_graphs(bundles)
    node = F.get(F.col("nodes"), F.element_at("seen", -1))
    techniques = F.filter(F.transform("seen", lambda i: F.get(F.col("nodes"), i)["technique"]), lambda t: t.isNotNull())
    path, kind = shared_folder(bundles.sparkSession, "bundle-paths"), bundles.schema["bundle"].dataType.simpleString()
    now = graphs.select("row", "bundle", "nodes", F.explode("starts").alias("i")).select("row", "bundle", "nodes", F.array("i").alias("seen"))
    while True:
        for _ in range(REACH - 1):
            ahead = F.filter(node["to"], lambda i: ~F.array_contains("seen", i))
            ways = F.when(node["leaf"], F.array(F.lit(-1))).otherwise(ahead)
            now = now.select("row", "bundle", "nodes", "seen", F.explode(ways).alias("i"))
            now = now.select("row", "bundle", "nodes", F.when(F.col("i") < 0, F.col("seen")).otherwise(F.concat("seen", F.array("i"))).alias("seen"))
        ends = now.select("row", "bundle", node["leaf"].alias("leaf"), F.when(node["leaf"], techniques).alias("techniques"), F.when(~node["leaf"], F.col("seen")).alias("seen"))
        ends = stored(ends.where("NOT leaf OR size(techniques) > 0"), "bundle-ways")
        ends.where("leaf").select("bundle", "techniques").write.mode("append").parquet(path)
        longer = ends.where("NOT leaf").select("row", "seen")
        if not longer.head(1):
            return bundles.sparkSession.read.schema(f"bundle {kind}, techniques array<string>").parquet(path)
        now = longer.join(graphs.drop("starts"), "row").select("row", "bundle", "nodes", "seen")
