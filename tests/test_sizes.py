"""Results that hold on larger tables: sums in any order, and stages without benign rows."""

import os

import duckdb

import __spark_entry__ as entry
from tidewatch.operators import windows as W

SF = "/root/testdata/sf0.001"


def test_entropy_of_sums_in_any_order(spark):
    edges = spark.createDataFrame([(0, 0, "a", "x", 2, 0.1 + 0.2), (0, 0, "b", "x", 2, 0.3), (0, 1, "a", "x", 2, 0.3), (0, 1, "b", "x", 2, 0.4)], "scenario long, k long, src string, dst string, events long, bytes double")
    assert {r["k"]: r["edge_entropy"] for r in W.edge_features(edges).collect()} == {0: 0.0, 1: 1.0}


def test_stage_cuts_without_benign_rows(spark, tmp_path):
    con = duckdb.connect()
    for f in os.listdir(SF):
        t = f.removesuffix(".parquet")
        kept = "* REPLACE ('error' AS event_type, '{\"k\": ' || (5 + event_id // 100 % 2 * 4) || '}' AS props)" if t == "events" else "*"
        con.execute(f"COPY (SELECT {kept} FROM '{SF}/{f}') TO '{tmp_path}/{f}' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{f}'")
    df = entry.queries()["k36_stage_cuts"](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()['k36_stage_cuts']}) ORDER BY fold").fetchall()
    got = [tuple(r) for r in df.orderBy("fold").collect()]
    assert got == want and len(got) > 0 and {r["benign_windows"] for r in df.collect()} == {0} and {r["threshold"] for r in df.collect()} == {0.5}


def test_flows_share_few_states(spark, tmp_path):
    """Fifty pairs of ends in three states, some silent long enough to end by the timer, each flow whole."""
    from pyspark.sql import functions as F

    from tidewatch.streaming import live

    second = 1_000_000
    rows = [((1000 + 3 * i + 200 * part) * second, f"h{k:02d}", "z", 9, 9, 6, 1.0, 16) for k in range(50) for part in range(1 + k % 2) for i in range(1 + k % 3)]
    frame = spark.createDataFrame(rows, "us long, src string, dst string, sport int, dport int, protocol int, bytes double, tcp_flags int").withColumn("ts", F.timestamp_micros("us"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.closable(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), str(tmp_path / "end"))
    out = live.drain(live.flow_stream(stream, buckets=3), "flows", str(tmp_path / "c"), (frame.schema, str(tmp_path / "end"))).where("lo <> ''").collect()
    got = sorted((r["lo"], r["start"] // second, r["packets"], r["protocol"]) for r in out)
    assert got == sorted((f"h{k:02d}:9", 1000 + 200 * part, 1 + k % 3, 6) for k in range(50) for part in range(1 + k % 2))


def test_paths_come_from_one_table(spark):
    """The plan is one scan however long the paths are; doubled links count once, a cycle ends a path."""
    from tidewatch.operators import correlate as C

    nodes = spark.createDataFrame([("b", x) for x in "1234"], "bundle string, id string")
    links = spark.createDataFrame([("b", "1", "2"), ("b", "1", "2"), ("b", "1", "3"), ("b", "2", "3"), ("b", "3", "4"), ("b", "4", "1")], "bundle string, src string, dst string")
    out = C.paths(nodes, links, nodes.where("id = '1'"))
    assert sorted("".join(r["path"]) for r in out.collect()) == ["1234", "134"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "Aggregate" not in plan


def test_ways_of_a_bundle_are_one_table_a_scan(spark, monkeypatch):
    """A way of up to REACH nodes needs two tables, a longer one two scans more; both are whole."""
    import json

    from tidewatch.operators import correlate as C

    def chain(n):
        nodes = [{"id": f"a{i}", "type": "attack-action", "technique_id": f"T{i}", "effect_refs": [f"a{i + 1}"] if i + 1 < n else []} for i in range(n)]
        return json.dumps({"objects": [{"id": "f", "type": "attack-flow", "start_refs": ["a0"]}, *nodes]})

    names, stored = [], C.stored
    monkeypatch.setattr(C, "stored", lambda df, name: names.append(name) or stored(df, name))
    for n, tables in ((C.REACH, 2), (2 * C.REACH + 5, 4)):
        names.clear()
        out = C.technique_paths(spark.createDataFrame([("b", chain(n))], "bundle string, json string")).collect()
        assert [r["techniques"] for r in out] == [[f"T{i}" for i in range(n)]] and len(names) == tables
