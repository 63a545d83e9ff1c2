"""Sliding event-time windows and the features of each window.

An event belongs to every window [origin + k stride, origin + k stride + width) that covers it, with the origin at its
scenario's first event and k from 0. The window numbers come from arithmetic, so there is no range join. Additive
features are one aggregate by (scenario, k) with map-side partials; features that need distinct values or counts of
values are two-level aggregates of their own, joined on (scenario, k), which keeps the plan free of wide Expands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import FLAG_BITS, bit, share

KEY = ["scenario", "k"]
#: The aggregates of each feature of a window.
POLICY = {
    "bytes": "sum mean std max p90", "packets": "sum mean max", "duration": "mean std max", "payload_size": "sum mean std p50 p90 entropy",
    "ttl": "mean std var min max nunique", "tcp_window_size": "mean std min max", "iat_mean": "mean var max min p90", "iat_variance": "mean max", "iat_max": "mean max",
    "retransmission": "sum mean", "bidirectional_ratio": "mean std", "syn_count": "sum mean", "ack_count": "sum mean", "fin_count": "sum mean", "rst_count": "sum mean", "urg_count": "sum mean",
    "failed_auth": "sum", "auth_attempt": "sum", "source_port": "nunique", "destination_port": "nunique", "protocol": "nunique", "tcp_flags": "nunique",
}
#: Flat names that stand for one aggregate.
ALIASES = {
    "bytes": "bytes_sum", "packets": "packets_sum", "duration": "duration_mean", "payload_size": "payload_size_sum", "iat_mean": "iat_mean_mean", "failed_auth": "failed_auth_sum", "auth_attempt": "auth_attempt_sum",
    "syn_count": "syn_count_sum", "ack_count": "ack_count_sum", "fin_count": "fin_count_sum", "rst_count": "rst_count_sum", "urg_count": "urg_count_sum",
}
# Kill-chain order of the window label's precedence.
STAGE_RANK = {"Benign": 0, "Reconnaissance": 1, "Initial Access": 2, "Credential Access": 3, "Command and Control": 4, "Exfiltration": 5, "Lateral Movement": 6}


def assign(events: DataFrame, width: int, stride: int) -> DataFrame:
    """events with k, a row for each window that covers the event; width and stride in micros."""
    origin = events.groupBy("scenario").agg(F.min("us").alias("origin")).withColumnRenamed("scenario", "o_scenario")
    placed = events.join(origin, F.col("scenario").eqNullSafe(F.col("o_scenario"))).drop("o_scenario")
    since = F.col("us") - F.col("origin")
    first = F.greatest(F.lit(0).cast("long"), F.floor((since - width) / F.lit(stride)) + 1)
    return placed.withColumn("k", F.explode(F.sequence(first, F.floor(since / F.lit(stride)))))


def state_index(states: DataFrame) -> DataFrame:
    """Dense place of each emitted window in its scenario, from 0."""
    return states.withColumn("idx", F.row_number().over(Window.partitionBy("scenario").orderBy("k")).cast("long") - 1)


def grid(states: DataFrame) -> DataFrame:
    """(scenario, k) with the empty windows between a scenario's first and last one filled in."""
    ends = states.groupBy("scenario").agg(F.max("k").alias("top"))
    return ends.select("scenario", F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("k"))


def value_stats(name: str) -> list[Column]:
    """sum, mean, min, max, sample std and variance (null below two values) of one feature."""
    two = F.count(name) >= 2
    return [
        F.sum(name).alias(f"{name}_sum"), F.avg(name).alias(f"{name}_mean"), F.min(name).alias(f"{name}_min"), F.max(name).alias(f"{name}_max"),
        F.when(two, F.stddev_samp(name)).alias(f"{name}_std"), F.when(two, F.var_samp(name)).alias(f"{name}_var"),
    ]


def percentiles(name: str, levels=(0.5, 0.9, 0.99)) -> list[Column]:
    """Linear-interpolation percentiles, null below two values."""
    return [F.when(F.count(name) >= 2, F.percentile(name, p)).alias(f"{name}_p{int(p * 100)}") for p in levels]


def entropy(members: DataFrame, value: Column, name: str, least: int = 1) -> DataFrame:
    """Shannon entropy (bits) of a value's counts in each window; null below ``least`` values."""
    counts = members.where(value.isNotNull()).groupBy(*KEY, value.alias("v")).agg(F.count("*").alias("n"))
    total = F.sum("n")
    # sum of p log2 p from counts: log2 N - sum(n log2 n) / N, never below 0
    bits = F.greatest(F.lit(0.0), F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total)
    return counts.groupBy(*KEY).agg(F.when(total >= least, bits).alias(name))


def policy_features(members: DataFrame, policy: dict[str, str] = POLICY) -> DataFrame:
    """The aggregates of each feature by window, named feature_aggregate; null where a window lacks the feature.

    Spread, percentiles and entropy need two values. All but distinct counts and entropies are one aggregate with
    map-side partials; those are two-level aggregates joined by window.
    """
    made = []
    for name, kinds in policy.items():
        two = lambda c, name=name: F.when(F.count(name) >= 2, c)
        each = {
            "sum": F.sum(name), "mean": F.avg(name), "max": F.max(name), "min": F.min(name), "std": two(F.stddev_samp(name)), "var": two(F.var_samp(name)),
            **{f"p{p}": two(F.percentile(name, p / 100)) for p in (50, 90, 99) if f"p{p}" in kinds.split()},
        }
        made += [each[k].cast("double").alias(f"{name}_{k}") for k in kinds.split() if k in each]
    out = members.groupBy(*KEY).agg(*made)
    for name, kinds in policy.items():
        if "nunique" in kinds.split():
            out = out.join(distinct_count(members, [name], f"{name}_nunique"), KEY, "left")
        if "entropy" in kinds.split():
            out = out.join(entropy(members, F.col(name).cast("long"), f"{name}_entropy", least=2), KEY, "left")
    return out


def with_aliases(features: DataFrame, aliases: dict[str, str] = ALIASES) -> DataFrame:
    """features with the flat names of those aggregates that it has."""
    return features.withColumns({flat: F.col(full) for flat, full in aliases.items() if full in features.columns and flat not in features.columns})


def distinct_count(members: DataFrame, columns: list[str], name: str) -> DataFrame:
    """Distinct non-null combinations in each window, by two levels of grouping."""
    rows = members.dropna(subset=columns).groupBy(*KEY, *columns).agg(F.lit(1).alias("one"))
    return rows.groupBy(*KEY).agg(F.count("*").alias(name))


def per_source(members: DataFrame, column: str, how: Column, name: str) -> DataFrame:
    """An aggregate over sources of each source's distinct values; ``how`` reads the column n."""
    rows = members.dropna(subset=[column]).groupBy(*KEY, "src", column).agg(F.lit(1).alias("one"))
    return rows.groupBy(*KEY, "src").agg(F.count("*").alias("n")).groupBy(*KEY).agg(how.alias(name))


def edges(members: DataFrame) -> DataFrame:
    """Events and bytes of each (src, dst) in each window; bytes fall back to the payload size, then 0."""
    size = F.coalesce(F.col("bytes"), F.col("payload_size"), F.lit(0.0)) if "payload_size" in members.columns else F.coalesce(F.col("bytes"), F.lit(0.0))
    return members.groupBy(*KEY, "src", "dst").agg(F.count("*").alias("events"), F.sum(size).alias("bytes"))


def entities(edge_rows: DataFrame) -> DataFrame:
    """Distinct entities of each window, from its edges."""
    return edge_rows.select(*KEY, F.explode(F.array("src", "dst")).alias("entity")).distinct()


def external(entity: Column, prefixes=("external", "1.2.3.4")) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | entity.startswith(p)
    return out


def event_kinds(members: DataFrame, kind: str, prefixes=("external", "1.2.3.4")) -> DataFrame:
    """Events, flows and packets of each window, and its distinct outside entities."""
    counts = members.groupBy(*KEY).agg(F.count("*").alias("event_count"), F.count_if(F.col(kind) == "flow").alias("flow_event_count"), F.count_if(F.col(kind) == "packet").alias("packet_event_count"))
    outside = entities(members.select(*KEY, "src", "dst").distinct()).groupBy(*KEY).agg(F.count_if(external(F.col("entity"), prefixes)).alias("external_destination_count"))
    return counts.join(outside, KEY)


def flag_sums() -> list[Column]:
    """Sum and mean of each single flag."""
    out = []
    for name in ("SYN", "ACK", "FIN", "RST", "URG"):
        hit = bit("tcp_flags", FLAG_BITS[name]).cast("double")
        out += [F.sum(hit).alias(f"{name.lower()}_count_sum"), F.avg(hit).alias(f"{name.lower()}_count_mean")]
    return out


def flag_ratios() -> list[Column]:
    syn, ack = bit("tcp_flags", FLAG_BITS["SYN"]), bit("tcp_flags", FLAG_BITS["ACK"])
    xmas = F.col("tcp_flags").cast("int").bitwiseAND(F.lit(41)) == 41
    out = [share(bit("tcp_flags", FLAG_BITS[n])).alias(f"flag_{n.lower()}_ratio") for n in ("SYN", "ACK", "FIN", "RST", "PSH", "URG")]
    out.append((F.count_if(syn) / F.greatest(F.count_if(ack), F.lit(1))).alias("flag_syn_ack_ratio"))
    out.append(share(syn & ~ack).alias("flag_syn_no_ack_share"))
    return [*out, share(xmas).alias("flag_xmas_share")]


def protocol_shares() -> list[Column]:
    return [share(F.col("protocol") == n).alias(f"proto_{name}_share") for name, n in (("tcp", 6), ("udp", 17), ("icmp", 1))]


def port_shares() -> list[Column]:
    return [
        share(F.col("dport") < 1024).alias("dst_port_wellknown_share"), share(F.col("dport").between(1024, 49151)).alias("dst_port_registered_share"),
        share(F.col("sport") >= 49152).alias("src_port_ephemeral_share"), share(F.col("sport") > 1024).alias("src_port_high_ratio"),
    ]


def fragment_shares() -> list[Column]:
    return [share(bit("fragment_flags", 0x4000)).alias("frag_df_share"), share(bit("fragment_flags", 0x2000)).alias("frag_mf_share")]


def fragments(members: DataFrame, first: str = "header_flags", other: str = "ip_flags") -> DataFrame:
    """Shares of don't-fragment and more-fragments: of ``first`` where a window has any, else of ``other``; 0 with neither."""
    def shares(mask: int) -> Column:
        return F.coalesce(*[F.avg((F.col(c).cast("int").bitwiseAND(F.lit(mask)) != 0).cast("double")) for c in (first, other)], F.lit(0.0))

    return members.groupBy(*KEY).agg(shares(0x4000).alias("frag_df_share"), shares(0x2000).alias("frag_mf_share"))


def retransmissions() -> list[Column]:
    hit = F.coalesce(F.col("retransmission") != 0, F.lit(False))
    return [F.count_if(hit).alias("retransmission_count"), F.avg(hit.cast("double")).alias("retransmission_rate")]


def iat_stats(name: str = "iat_mean") -> list[Column]:
    """Mean, variance, max, min, p90 and coefficient of variation of arrival gaps; 0 below two values."""
    two, zero = F.count(name) >= 2, F.lit(0.0)
    keep = lambda c: F.coalesce(F.when(two, c), zero)
    return [
        keep(F.avg(name)).alias("iat_avg"), keep(F.var_samp(name)).alias("iat_variance"), keep(F.max(name)).alias("iat_max"), keep(F.min(name)).alias("iat_min"),
        keep(F.percentile(name, 0.9)).alias("iat_p90"), keep(F.when(F.avg(name) > 0, F.stddev_samp(name) / F.avg(name))).alias("iat_cv"),
    ]


def bidirectional_ratio(members: DataFrame, tuple_columns: list[str]) -> DataFrame:
    """Reverse bytes over all bytes for each endpoint pair and window; reverse runs from the greater endpoint to the lesser."""
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    rows = members.groupBy(*KEY, a.alias("a"), b.alias("b"), *tuple_columns).agg(F.sum("bytes").alias("total"), F.sum(F.when(F.col("src") > F.col("dst"), F.col("bytes"))).alias("reverse"))
    return rows.withColumn("ratio", F.when(F.col("total") > 0, F.coalesce("reverse", F.lit(0.0)) / F.col("total")))


def sequential_ports(members: DataFrame) -> DataFrame:
    """Mean over sources (with three ports or more) of the share of steps of one between consecutive destination ports."""
    order = Window.partitionBy(*KEY, "src").orderBy("us", "event_id")
    step = members.where("dport is not null").withColumn("step", F.abs(F.col("dport") - F.lag("dport").over(order)))
    each = step.groupBy(*KEY, "src").agg(F.count("*").alias("n"), F.avg((F.col("step") == 1).cast("double")).alias("s")).where("n >= 3")
    return each.groupBy(*KEY).agg(F.avg("s").alias("sequential_score"), (1 - F.avg("s")).alias("port_randomness"))


def window_label(members: DataFrame, stage: str = "stage", order: str = "event_id") -> DataFrame:
    """The stage of the highest precedence in a window; among equals the last event in input order decides."""
    rank = F.lit(0)
    for name, r in STAGE_RANK.items():
        rank = F.when(F.col(stage) == name, F.lit(r)).otherwise(rank)
    best = F.max_by(F.struct(F.col(stage).alias("stage"), (F.col(stage) != "Benign").alias("infiltration")), F.struct(rank, F.col(order)))
    return members.groupBy(*KEY).agg(best.alias("x")).select(*KEY, "x.stage", "x.infiltration")


def fallback_features(members: DataFrame, features: str = "features", known: tuple[str, ...] = ()) -> DataFrame:
    """Sums of the named features in a map column that no policy knows: (scenario, k, name, total)."""
    rows = members.select(*KEY, F.explode(features).alias("name", "value"))
    return rows.where(~F.col("name").isin(list(known)) if known else F.lit(True)).groupBy(*KEY, "name").agg(F.sum("value").alias("total"))


def feature_names(rows: DataFrame, features: list[str]) -> DataFrame:
    """(feature, windows): the union of the feature names of all windows, and how many windows have each; a null is an absent one."""
    present = F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in features]))
    return rows.select(F.explode(present).alias("feature")).groupBy("feature").agg(F.count("*").alias("windows"))


def schema_mismatch(names: DataFrame, expected: DataFrame) -> DataFrame:
    """(feature, status): the features that a model expects and no window has ('missing'), and the other way round ('unexpected')."""
    missing = expected.join(names, "feature", "left_anti").select("feature", F.lit("missing").alias("status"))
    return missing.union(names.join(expected, "feature", "left_anti").select("feature", F.lit("unexpected").alias("status")))


def states(members: DataFrame, edge_rows: DataFrame) -> DataFrame:
    """The wide table the detectors read: one row for each emitted window, with idx."""
    additive = members.groupBy(*KEY).agg(
        F.count("*").alias("event_count"), F.count_if(F.col("kind") == "flow").alias("flow_count"), F.sum("bytes").alias("bytes"), F.sum("failed_auth").alias("failed_auth"), F.sum(bit("tcp_flags", 4).cast("double")).alias("rst_count"),
        F.sum("retransmission").alias("retransmission"), F.sum("domain_length").alias("domain_length"), F.sum("tunnel").alias("tunnel"), F.sum("beacon").alias("beacon"), F.sum("execs").alias("execs"),
    )
    return state_index(additive.join(edge_features(edge_rows), KEY))


def edge_features(edge_rows: DataFrame) -> DataFrame:
    """Low-byte probe share, greatest fan-out and byte entropy of each window's edges.

    The entropy takes bytes at six digits, so that equal sums are one value in whatever order they were added.
    """
    low = edge_rows.groupBy(*KEY).agg(share((F.col("events") > 0) & (F.col("bytes") / F.col("events") < 200.0)).alias("probe_share"), F.count("*").alias("edge_count"))
    fan = edge_rows.groupBy(*KEY, "src").agg(F.count("*").alias("n")).groupBy(*KEY).agg(F.max("n").alias("max_fanout"))
    bits = entropy(edge_rows, F.when(F.col("bytes") > 0, F.round("bytes", 6)), "edge_entropy")
    return low.join(fan, KEY).join(bits, KEY, "left")
