"""Readers over small written files."""

from pyspark.sql import functions as F

from tidewatch.sources import readers as R


def put(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text)
    return str(path)


def test_flow_csv(spark, tmp_path):
    head = "timestamp,source_entity,destination_entity,source_port,destination_port,protocol,bytes,packets,duration,tcp_flags"
    path = put(tmp_path, "flows.csv", f"{head}\n2026-01-01T00:00:00Z,host-a,server-a,1000,443,tcp,1200,4,0.5,SYN ACK\n2026-01-01T00:00:30Z,host-a,server-b,1000,x,udp,850,4,0.5,SYN\n")
    events, rejects = R.read_flow_csv(spark, path)
    row = events.collect()
    assert len(row) == 1 and row[0]["protocol"] == 6 and row[0]["tcp_flags"] == 18 and row[0]["event_id"] == "flows.csv:2"
    assert [r["line_no"] for r in rejects.collect()] == [3]
    report = R.coverage(spark.read.csv(path, header=True).columns, events).first()
    assert report["present"] == "tcp_flags" and "ttl" in report["missing"]


def test_labelled_flows(spark, tmp_path):
    head = "Flow ID, Source IP, Destination IP, Source Port, Destination Port, Protocol, Timestamp, Flow Duration, Total Fwd Packets, Total Backward Packets, Total Length of Fwd Packets, Total Length of Bwd Packets, FIN Flag Count, SYN Flag Count, RST Flag Count, PSH Flag Count, ACK Flag Count, Flow IAT Mean, Label"
    rows = ["f,a,b,1,2,6,3/7/2017 2:05,2000000,1,2,Infinity,50,0,1,0,0,1,3.5,Web Attack – XSS", ",,,,,,,,,,,,,,,,,,", "g,a,b,1,2,6,nonsense,1,1,1,1,1,0,0,0,0,0,1,BENIGN"]
    out = R.read_labelled_flows(spark, put(tmp_path, "l.csv", "\n".join([head, *rows])))
    counts = R.conversion_counts(out).first()
    assert (counts["read"], counts["converted"], counts["rejected"], counts["void"]) == (3, 1, 1, 1)
    row = out.where("status = 'converted'").first()
    assert row["bytes"] == 50.0 and row["packets"] == 3.0 and row["duration"] == 2.0 and row["tcp_flags"] == 18 and row["ts"].hour == 14
    rules = spark.createDataFrame([("Web Attack - XSS", "Initial Access", True)], "label string, stage string, infiltration boolean")
    mapped, missing = R.map_labels(out.where("status <> 'void'"), rules)
    assert mapped.count() == 1 and [r["label"] for r in missing.collect()] == ["benign"]


def test_text_logs(spark, tmp_path):
    lines = lambda name, text: R.text_lines(spark, put(tmp_path, name, text))
    dns = R.parse_dns(lines("d", "2026-01-01T00:00:00 c 8.8.8.8 evil.com tunnel\nbad line\nxx c r abc.org\n")).orderBy("event_id").collect()
    assert [(r["domain_length"], r["tunnel"]) for r in dns] == [(8.0, 1.0), (7.0, 0.0)] and dns[1]["ts"].second == 2
    auth = R.parse_auth(lines("a", "2026-01-01T00:00:00 host-01 auth-service FAILED bob\n2026-01-01T00:00:01 h t OK x\n")).orderBy("ts").collect()
    assert [r["failed_auth"] for r in auth] == [1.0, 0.0]
    log = R.parse_syslog(lines("s", "1700000000 h app src=a destination=b failed_auth=yes bytes=12 note=x\nnoise here\n")).collect()
    assert len(log) == 1 and log[0]["failed_auth"] == 1.0 and log[0]["features"] == {"bytes": 12.0}
    web = R.parse_http(lines("h", "2026-01-01T00:00:00 src=a dst=b dport=80 method=POST path=/login status=401\n")).first()
    assert (web["dst"], web["auth_attempt"], web["failed_auth"], web["rst_count"]) == ("b:/login", 1.0, 1.0, 1.0)
    packet = R.parse_packets(lines("p", "1700000000.5 IP a.10 > b.20: Flags [S.], seq 1, length 77\n")).first()
    assert (packet["src"], packet["sport"], packet["dport"], packet["tcp_flags"], packet["bytes"]) == ("a", 10, 20, 18, 77.0)


def test_threat_feed(spark, tmp_path):
    text = '# banner\n"1","2026","http://Bad.example/x","online","t","tag"\n"2","2026","http://other.example:81/","online","t","tag"\n"3","2027","http://bad.example/y","online","t","new"\nno url here\n'
    rows = {r["indicator"]: r["list_type"] for r in R.read_threat_feed(spark, put(tmp_path, "feed.csv", text)).collect()}
    assert rows == {"bad.example": "new", "other.example:81": "tag"}


def test_states_round_trip(spark, tmp_path):
    states = spark.createDataFrame([("s", 0, 1.5, None, "Benign")], "scenario string, idx int, bytes double, ttl double, stage string")
    R.write_states(states, ["bytes", "ttl"], str(tmp_path / "w"), {"window": 60})
    rows, meta = R.read_states(spark, str(tmp_path / "w"))
    row = rows.first()
    assert row["bytes"] == 1.5 and row["ttl"] == 0.0 and meta.first()["window"] == "60"


def test_flow_assembly(spark):
    second = 1_000_000
    rows = [(0, "a", "b", 2, 1), (1 * second, "b", "a", 18, 2), (30 * second, "a", "b", 16, 3), (31 * second, "a", "b", 1, 4), (32 * second, "a", "b", 16, 5)]
    packets = spark.createDataFrame([(u, s, d, 9, 9, 6, 10.0, f, n) for u, s, d, f, n in rows], "us long, src string, dst string, sport int, dport int, protocol int, bytes double, tcp_flags int, packet_no int")
    out = R.assemble_flows(packets).orderBy("start").collect()
    assert [r["packets"] for r in out] == [2, 2, 1] and out[0]["iat_mean"] == 1000.0


def test_stream_flows_match(spark, tmp_path):
    from tidewatch.streaming import live

    second = 1_000_000
    rows = [((1000 + s) * second, a, b, 9, 9, 6, 10.0, f) for s, a, b, f in ((0, "a", "b", 2), (1, "b", "a", 18), (2, "a", "b", 1), (40, "a", "b", 2), (41, "a", "b", 4))]
    frame = spark.createDataFrame(rows, "us long, src string, dst string, sport int, dport int, protocol int, bytes double, tcp_flags int")
    frame.withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    out = live.drain(live.flow_stream(stream), "flows_test", str(tmp_path / "c")).orderBy("start").collect()
    assert [(r["packets"], r["bytes"]) for r in out] == [(3, 30.0), (2, 20.0)]
