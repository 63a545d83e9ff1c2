"""Windowing and window features: C3, C4, D1 to D22, E1, E10, G3, M5."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..events import EVENTS_SQL, FLOWS_SQL, HOUR, PACKET_FEATURES, STRIDE, WIDTH, events, flows, with_packets
from ..operators import windows as W

DAY = 24 * HOUR


def members_sql(source: str, width: int, stride: int) -> str:
    return f"""{source},
org AS (SELECT scenario, min(us) AS origin FROM ev GROUP BY scenario),
mem AS (SELECT ev.*, origin, unnest(range(greatest(0, CAST(floor((us - origin - {width}) / CAST({stride} AS DOUBLE)) AS BIGINT) + 1), CAST(floor((us - origin) / CAST({stride} AS DOUBLE)) AS BIGINT) + 1)) AS k FROM ev JOIN org USING (scenario))"""


MEMBERS = members_sql(EVENTS_SQL, WIDTH, STRIDE)
EDGES = MEMBERS + """,
edge AS (SELECT scenario, k, src, dst, count(*) AS events, sum(coalesce(bytes, payload_size, 0)) AS bytes FROM mem GROUP BY ALL)"""
QUERIES, ORACLE_SQL = {}, {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def members(spark, sf_dir):
    return W.assign(events(spark, sf_dir), WIDTH, STRIDE)


def edge_table(spark, sf_dir):
    return W.edges(members(spark, sf_dir))


def rounded(df, skip=("scenario", "k", "idx")):
    """Doubles to six digits."""
    return df.select(*[F.round(c, 9 if c.endswith("_mean") else 6).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes])


def simple(name: str, columns, sql_columns: str):
    """A query that is one aggregate by window."""

    @query(name, f"WITH {MEMBERS} SELECT scenario, k, {sql_columns} FROM mem GROUP BY scenario, k")
    def run(spark, sf_dir):
        return rounded(members(spark, sf_dir).groupBy(*W.KEY).agg(*columns()))

    return run


def r(expr: str, name: str) -> str:
    return f"round({expr}, {9 if name.endswith('_mean') else 6}) AS {name}"


@query("c3_event_windows", f"WITH {MEMBERS} SELECT event_id, scenario, k FROM mem")
def c3(spark, sf_dir):
    return members(spark, sf_dir).select("event_id", "scenario", "k")


@query("c3_flow_windows_daily", f"WITH {members_sql(FLOWS_SQL, 7 * DAY, DAY)} SELECT scenario, k, count(*) AS n, round(sum(bytes), 2) AS bytes, round(sum(packets), 2) AS packets, count(*) FILTER (tcp_flags & 4 <> 0) AS resets FROM mem GROUP BY scenario, k")
def c3_flows(spark, sf_dir):
    hit = F.col("tcp_flags").bitwiseAND(F.lit(4)) != 0
    return W.assign(flows(spark, sf_dir), 7 * DAY, DAY).groupBy(*W.KEY).agg(F.count("*").alias("n"), F.round(F.sum("bytes"), 2).alias("bytes"), F.round(F.sum("packets"), 2).alias("packets"), F.count_if(hit).alias("resets"))


@query("d9_window_label", f"""WITH {MEMBERS}, rk AS (SELECT *, CASE stage WHEN 'Reconnaissance' THEN 1 WHEN 'Exfiltration' THEN 5 WHEN 'Lateral Movement' THEN 6 ELSE 0 END AS rank FROM mem),
t AS (SELECT scenario, k, stage, row_number() OVER (PARTITION BY scenario, k ORDER BY rank DESC, event_id DESC) AS rn FROM rk)
SELECT scenario, k, stage, stage <> 'Benign' AS infiltration FROM t WHERE rn = 1""")
def d9(spark, sf_dir):
    return W.window_label(members(spark, sf_dir))


@query("c4_event_window_labels", f"WITH {MEMBERS} SELECT scenario, k, stage, count(*) AS events, min(event_id) AS first_event FROM mem GROUP BY scenario, k, stage")
def c4(spark, sf_dir):
    """Labelled events of each window, by membership."""
    return members(spark, sf_dir).groupBy(*W.KEY, "stage").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


def stats_sql(name: str) -> str:
    return ", ".join([r(f"sum({name})", f"{name}_sum"), r(f"avg({name})", f"{name}_mean"), r(f"min({name})", f"{name}_min"), r(f"max({name})", f"{name}_max"), r(f"CASE WHEN count({name}) >= 2 THEN stddev_samp({name}) END", f"{name}_std"), r(f"CASE WHEN count({name}) >= 2 THEN var_samp({name}) END", f"{name}_var")])


POLICY = ("bytes", "packets", "duration", "payload_size", "ttl")
simple("d1_window_features", lambda: [c for n in POLICY for c in W.value_stats(n)] + [F.count("*").alias("event_count")], ", ".join(stats_sql(n) for n in POLICY) + ", count(*) AS event_count")
simple("d2_sample_spread", lambda: [F.when(F.count("bytes") >= 2, F.stddev_samp("bytes")).alias("bytes_std"), F.when(F.count("bytes") >= 2, F.var_samp("bytes")).alias("bytes_var")], r("CASE WHEN count(bytes) >= 2 THEN stddev_samp(bytes) END", "bytes_std") + ", " + r("CASE WHEN count(bytes) >= 2 THEN var_samp(bytes) END", "bytes_var"))
simple("d3_percentiles", lambda: W.percentiles("bytes") + W.percentiles("duration"), ", ".join(r(f"CASE WHEN count({n}) >= 2 THEN quantile_cont({n}, {p}) END", f"{n}_p{int(p * 100)}") for n in ("bytes", "duration") for p in (0.5, 0.9, 0.99)))
simple("d6_counts_and_coverage", lambda: [F.count("*").alias("event_count"), F.count_if(F.col("event_type") == "error").alias("auth_count"), (F.count_if(F.col("event_type") == "view") > 0).alias("has_dns"), F.count("payload_size").alias("with_payload")], "count(*) AS event_count, count(*) FILTER (event_type = 'error') AS auth_count, count(*) FILTER (event_type = 'view') > 0 AS has_dns, count(payload_size) AS with_payload")
KIND = "CASE WHEN event_type = 'error' THEN 'auth' WHEN event_type = 'view' THEN 'dns' WHEN event_id % 3 = 0 THEN 'packet' ELSE 'flow' END"


@query("d6_event_kinds", f"WITH {MEMBERS}, y AS (SELECT scenario, k, {KIND} AS sort, src, dst FROM mem), n AS (SELECT scenario, k, count(*) AS event_count, count(*) FILTER (sort = 'flow') AS flow_event_count, count(*) FILTER (sort = 'packet') AS packet_event_count FROM y GROUP BY scenario, k), x AS (SELECT scenario, k, count(DISTINCT e) FILTER (e LIKE 'user-1%') AS external_destination_count FROM (SELECT scenario, k, unnest([src, dst]) AS e FROM y) GROUP BY scenario, k) SELECT * FROM n JOIN x USING (scenario, k)")
def d6_kinds(spark, sf_dir):
    return W.event_kinds(members(spark, sf_dir).withColumn("sort", F.expr(KIND)), "sort", ("user-1",))


FLAG = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32}
simple("d10_flag_sums", W.flag_sums, ", ".join(r(f"sum(CAST((tcp_flags & {FLAG[n]}) <> 0 AS DOUBLE))", f"{n}_count_sum") + ", " + r(f"avg(CAST((tcp_flags & {FLAG[n]}) <> 0 AS DOUBLE))", f"{n}_count_mean") for n in ("syn", "ack", "fin", "rst", "urg")))
simple("d11_flag_ratios", W.flag_ratios, ", ".join(r(f"avg(CAST((tcp_flags & {FLAG[n]}) <> 0 AS DOUBLE))", f"flag_{n}_ratio") for n in ("syn", "ack", "fin", "rst", "psh", "urg")) + ", " + r("count(*) FILTER ((tcp_flags & 2) <> 0) / CAST(greatest(count(*) FILTER ((tcp_flags & 16) <> 0), 1) AS DOUBLE)", "flag_syn_ack_ratio") + ", " + r("avg(CAST((tcp_flags & 2) <> 0 AND (tcp_flags & 16) = 0 AS DOUBLE))", "flag_syn_no_ack_share") + ", " + r("avg(CAST((tcp_flags & 41) = 41 AS DOUBLE))", "flag_xmas_share"))
simple("d12_protocol_shares", W.protocol_shares, ", ".join(r(f"avg(CAST(protocol = {n} AS DOUBLE))", f"proto_{m}_share") for m, n in (("tcp", 6), ("udp", 17), ("icmp", 1))))
simple("d16_fragments", lambda: [*W.fragment_shares(), F.count_distinct("frag_offset").alias("frag_offset_nunique")], r("avg(CAST((fragment_flags & 16384) <> 0 AS DOUBLE))", "frag_df_share") + ", " + r("avg(CAST((fragment_flags & 8192) <> 0 AS DOUBLE))", "frag_mf_share") + ", count(DISTINCT frag_offset) AS frag_offset_nunique")
simple("d17_retransmissions", W.retransmissions, "count(*) FILTER (retransmission <> 0) AS retransmission_count, " + r("avg(CAST(retransmission <> 0 AS DOUBLE))", "retransmission_rate"))
IAT = {"iat_avg": "avg(iat_mean)", "iat_variance": "var_samp(iat_mean)", "iat_max": "max(iat_mean)", "iat_min": "min(iat_mean)", "iat_p90": "quantile_cont(iat_mean, 0.9)", "iat_cv": "CASE WHEN avg(iat_mean) > 0 THEN stddev_samp(iat_mean) / avg(iat_mean) END"}
simple("d18_arrival_gaps", W.iat_stats, ", ".join(r(f"coalesce(CASE WHEN count(iat_mean) >= 2 THEN {e} END, 0)", n) for n, e in IAT.items()))


def entropy_sql(value: str, table: str = "mem", least: int = 1, name: str = "bits") -> str:
    return f"""cnt AS (SELECT scenario, k, {value} AS v, count(*) AS n FROM {table} WHERE {value} IS NOT NULL GROUP BY ALL),
ent AS (SELECT scenario, k, CASE WHEN sum(n) >= {least} THEN round(greatest(0, log2(sum(n)) - sum(n * log2(n)) / sum(n)), 6) END AS {name} FROM cnt GROUP BY scenario, k)"""


PACKETS = MEMBERS + ", pk AS (SELECT *, " + ", ".join(f"{v} AS {k}" for k, v in PACKET_FEATURES.items()) + ", sport AS source_port, dport AS destination_port FROM mem)"


def packet_members(spark, sf_dir):
    return W.assign(with_packets(events(spark, sf_dir)).withColumns({"source_port": F.col("sport"), "destination_port": F.col("dport")}), WIDTH, STRIDE)


def policy_sql() -> list[str]:
    how = {"sum": "sum({0})", "mean": "avg({0})", "max": "max({0})", "min": "min({0})", "std": "stddev_samp({0})", "var": "var_samp({0})", "p50": "quantile_cont({0}, 0.5)", "p90": "quantile_cont({0}, 0.9)", "nunique": "nullif(count(DISTINCT {0}), 0)"}
    return [
        f"{how[k].format(n)} AS {n}_{k}" if k == "nunique" else f"round(CAST({how[k].format(n)} AS DOUBLE), {9 if k == 'mean' else 6}) AS {n}_{k}" if k in ("sum", "mean", "max", "min") else f"round(CASE WHEN count({n}) >= 2 THEN {how[k].format(n)} END, 6) AS {n}_{k}"
        for n, kinds in W.POLICY.items() for k in kinds.split() if k != "entropy"
    ]


POLICY_SQL = f"{PACKETS}, {entropy_sql('CAST(trunc(payload_size) AS BIGINT)', 'pk', 2, 'payload_size_entropy')}, po AS (SELECT scenario, k, {', '.join(policy_sql())} FROM pk GROUP BY scenario, k), pf AS (SELECT * FROM po LEFT JOIN ent USING (scenario, k))"


@query("d1_policy_features", f"WITH {POLICY_SQL} SELECT * FROM pf")
def d1_policy(spark, sf_dir):
    return rounded(W.policy_features(packet_members(spark, sf_dir)))


@query("b9_flat_names", f"WITH {POLICY_SQL} SELECT scenario, k, " + ", ".join(f"round({full}, 6) AS {flat}" for flat, full in W.ALIASES.items()) + " FROM pf")
def b9(spark, sf_dir):
    wanted = {n: " ".join(k for k in kinds.split() if f"{n}_{k}" == W.ALIASES.get(n)) for n, kinds in W.POLICY.items() if n in W.ALIASES}
    rows = W.with_aliases(W.policy_features(packet_members(spark, sf_dir), wanted))
    return rows.select("scenario", "k", *[F.round(c, 6).alias(c) for c in W.ALIASES])


def share_sql(mask: int) -> str:
    return "coalesce(" + ", ".join(f"avg(CAST(({c} & {mask}) <> 0 AS DOUBLE))" for c in ("header_flags", "ip_flags")) + ", 0)"


@query("d16_fragments_by_either", f"WITH {PACKETS} SELECT scenario, k, round({share_sql(16384)}, 6) AS frag_df_share, round({share_sql(8192)}, 6) AS frag_mf_share FROM pk GROUP BY scenario, k")
def d16_either(spark, sf_dir):
    return rounded(W.fragments(packet_members(spark, sf_dir)))


@query("d4_value_entropy", f"WITH {MEMBERS}, {entropy_sql('CAST(trunc(bytes) AS BIGINT)', name='bytes_entropy')} SELECT * FROM ent")
def d4(spark, sf_dir):
    return rounded(W.entropy(members(spark, sf_dir), F.col("bytes").cast("long"), "bytes_entropy"))


@query("d5_fallback_features", f"WITH {MEMBERS}, x AS (SELECT scenario, k, unnest(['extra_level', 'extra_odd']) AS name, unnest([CAST(level AS DOUBLE), CAST(event_id % 2 AS DOUBLE)]) AS value FROM mem) SELECT scenario, k, name, round(sum(value), 6) AS total FROM x GROUP BY ALL")
def d5(spark, sf_dir):
    rows = members(spark, sf_dir)
    rows = rows.withColumn("features", F.create_map(F.lit("extra_level"), F.col("level").cast("double"), F.lit("extra_odd"), (F.col("event_id") % 2).cast("double"), F.lit("bytes"), F.col("bytes")))
    return rounded(W.fallback_features(rows, known=("bytes",)))


@query("d7_external_entities", f"WITH {EDGES}, en AS (SELECT DISTINCT scenario, k, unnest([src, dst]) AS entity FROM edge) SELECT scenario, k, count(*) AS entity_count, count(*) FILTER (entity LIKE 'user-1%') AS external_count FROM en GROUP BY ALL")
def d7(spark, sf_dir):
    rows = W.entities(edge_table(spark, sf_dir))
    return rows.groupBy(*W.KEY).agg(F.count("*").alias("entity_count"), F.count_if(W.external(F.col("entity"), ("user-1",))).alias("external_count"))


@query("g3_window_entities", f"WITH {EDGES} SELECT DISTINCT scenario, k, unnest([src, dst]) AS entity FROM edge")
def g3(spark, sf_dir):
    return W.entities(edge_table(spark, sf_dir))


@query("d8_edges", f"WITH {EDGES} SELECT scenario, k, src, dst, events, round(bytes, 6) AS bytes FROM edge")
def d8(spark, sf_dir):
    return rounded(edge_table(spark, sf_dir))


@query("d13_ports", f"""WITH {MEMBERS}, {entropy_sql('dport', least=2, name='dst_port_entropy')},
a AS (SELECT scenario, k, count(DISTINCT dport) AS dst_port_nunique, {r("avg(CAST(dport < 1024 AS DOUBLE))", "dst_port_wellknown_share")}, {r("avg(CAST(dport BETWEEN 1024 AND 49151 AS DOUBLE))", "dst_port_registered_share")},
 {r("avg(CAST(sport >= 49152 AS DOUBLE))", "src_port_ephemeral_share")}, {r("avg(CAST(sport > 1024 AS DOUBLE))", "src_port_high_ratio")} FROM mem GROUP BY scenario, k)
SELECT * FROM a JOIN ent USING (scenario, k)""")
def d13(spark, sf_dir):
    rows = members(spark, sf_dir)
    out = rows.groupBy(*W.KEY).agg(*W.port_shares()).join(W.distinct_count(rows, ["dport"], "dst_port_nunique"), W.KEY).join(W.entropy(rows, F.col("dport"), "dst_port_entropy", 2), W.KEY)
    return rounded(out)


@query("d14_ports_per_host", f"WITH {MEMBERS}, p AS (SELECT scenario, k, src, count(DISTINCT dport) AS n FROM mem GROUP BY ALL) SELECT scenario, k, max(n) AS ports_per_host_max FROM p GROUP BY ALL")
def d14(spark, sf_dir):
    return W.per_source(members(spark, sf_dir), "dport", F.max("n"), "ports_per_host_max")


@query("d15_ttl_per_source", f"WITH {MEMBERS}, p AS (SELECT scenario, k, src, count(DISTINCT ttl) AS n FROM mem GROUP BY ALL) SELECT scenario, k, round(avg(n), 6) AS ttl_nunique_per_src FROM p GROUP BY ALL")
def d15(spark, sf_dir):
    return rounded(W.per_source(members(spark, sf_dir), "ttl", F.avg("n"), "ttl_nunique_per_src"))


@query("d19_bidirectional_ratio", f"""WITH {MEMBERS}, s AS (SELECT scenario, k, protocol, bytes, CASE WHEN event_id % 3 = 0 THEN dst ELSE src END AS src, CASE WHEN event_id % 3 = 0 THEN src ELSE dst END AS dst FROM mem)
SELECT scenario, k, least(src, dst) AS a, greatest(src, dst) AS b, protocol, round(sum(bytes), 6) AS total, round(sum(CASE WHEN src > dst THEN bytes END), 6) AS reverse,
 round(CASE WHEN sum(bytes) > 0 THEN coalesce(sum(CASE WHEN src > dst THEN bytes END), 0) / sum(bytes) END, 6) AS ratio FROM s GROUP BY ALL""")
def d19(spark, sf_dir):
    back = F.col("event_id") % 3 == 0
    rows = members(spark, sf_dir).select(*W.KEY, "protocol", "bytes", F.when(back, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(back, F.col("src")).otherwise(F.col("dst")).alias("dst"))
    return rounded(W.bidirectional_ratio(rows, ["protocol"]))


@query("d20_probe_share", f"WITH {EDGES} SELECT scenario, k, round(avg(CAST(events > 0 AND bytes / events < 200 AS DOUBLE)), 6) AS probe_share FROM edge GROUP BY scenario, k")
def d20(spark, sf_dir):
    return rounded(W.edge_features(edge_table(spark, sf_dir)).select(*W.KEY, "probe_share"))


@query("d21_max_fanout", f"WITH {EDGES}, f AS (SELECT scenario, k, src, count(*) AS n FROM edge GROUP BY ALL) SELECT scenario, k, max(n) AS max_fanout FROM f GROUP BY ALL")
def d21(spark, sf_dir):
    return W.edge_features(edge_table(spark, sf_dir)).select(*W.KEY, "max_fanout")


@query("d22_edge_byte_entropy", f"WITH {EDGES}, ed AS (SELECT scenario, k, CASE WHEN bytes > 0 THEN bytes END AS b FROM edge), {entropy_sql('b', 'ed', name='edge_entropy')} SELECT * FROM ent")
def d22(spark, sf_dir):
    return rounded(W.entropy(edge_table(spark, sf_dir), F.when(F.col("bytes") > 0, F.col("bytes")), "edge_entropy"))


@query("e1_state_index", f"WITH {MEMBERS} SELECT scenario, k, row_number() OVER (PARTITION BY scenario ORDER BY k) - 1 AS idx FROM (SELECT DISTINCT scenario, k FROM mem)")
def e1(spark, sf_dir):
    return W.state_index(members(spark, sf_dir).select(*W.KEY).distinct())


@query("e10_sequential_ports", f"""WITH {MEMBERS}, s AS (SELECT scenario, k, src, abs(dport - lag(dport) OVER (PARTITION BY scenario, k, src ORDER BY us, event_id)) AS step FROM mem),
p AS (SELECT scenario, k, src, avg(CAST(step = 1 AS DOUBLE)) AS s FROM s GROUP BY ALL HAVING count(*) >= 3)
SELECT scenario, k, round(avg(s), 6) AS sequential_score, round(1 - avg(s), 6) AS port_randomness FROM p GROUP BY ALL""")
def e10(spark, sf_dir):
    return rounded(W.sequential_ports(members(spark, sf_dir)))


@query("m5_empty_windows", f"WITH {MEMBERS}, t AS (SELECT scenario, max(k) AS top FROM mem GROUP BY scenario), g AS (SELECT scenario, unnest(range(0, top + 1)) AS k FROM t), c AS (SELECT scenario, k, count(*) AS n FROM mem GROUP BY ALL) SELECT g.scenario, g.k, coalesce(n, 0) AS event_count FROM g LEFT JOIN c ON g.scenario = c.scenario AND g.k = c.k")
def m5(spark, sf_dir):
    """Events of every window; the windows that the data leaves out have none."""
    rows = members(spark, sf_dir)
    counts = rows.groupBy(*W.KEY).agg(F.count("*").alias("n"))
    return W.grid(counts).join(counts, W.KEY, "left").select(*W.KEY, F.coalesce("n", F.lit(0)).alias("event_count"))
