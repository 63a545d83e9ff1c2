"""Streams to their end, against counts over the whole table."""

from pyspark.sql import functions as F

from tidewatch.queries import streams
from tidewatch.streaming import live

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000_000


def test_last_windows_are_flushed(spark):
    events = [(r["s"], r["us"]) for r in spark.read.parquet(f"{SF}/events.parquet").select((F.col("user_id") % 5).alias("s"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).collect()]
    tumbling, sliding = {}, {}
    for s, us in events:
        b = us // (3 * HOUR) * 3 * HOUR
        tumbling[s, b] = tumbling.get((s, b), 0) + 1
        for start in (b, b - 3 * HOUR):
            sliding[s, start] = sliding.get((s, start), 0) + 1
    for query, want in ((streams.m1, tumbling), (streams.m2, sliding)):
        rows = query(spark, SF).collect()
        assert len(rows) == len(want) and {(r["scenario"], r["start_us"]): r["event_count"] for r in rows} == want
    assert {r["scenario"]: r["windows"] for r in streams.m9(spark, SF).collect()} == {s: sum(k[0] == s for k in tumbling) for s in {k[0] for k in tumbling}}


def test_open_flows_are_flushed(spark, tmp_path):
    second = 1_000_000
    rows = [((1000 + s) * second, a, b, 9, 9, 6, 10.0, f) for s, a, b, f in ((0, "a", "b", 2), (1, "b", "a", 18), (2, "a", "b", 1), (40, "a", "b", 2), (41, "a", "b", 16))]
    frame = spark.createDataFrame(rows, "us long, src string, dst string, sport int, dport int, protocol int, bytes double, tcp_flags int").withColumn("ts", F.timestamp_micros("us"))
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.closable(spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in")), str(tmp_path / "end"))
    out = live.drain(live.flow_stream(stream), "flows", str(tmp_path / "c"), (frame.schema, str(tmp_path / "end"))).orderBy("start").collect()
    assert [(r["packets"], r["bytes"]) for r in out] == [(3, 30.0), (2, 20.0)]


PACKETS = "us long, src string, dst string, sport int, dport int, protocol int, bytes double, tcp_flags int, packet_no int"


def plain_flows(packets, idle, age):
    """(lo, hi, start, end, packets, bytes) of packets by a loop in time."""
    opened, out = {}, []
    for us, src, dst, *_, size, flags, _ in sorted(packets, key=lambda p: (p[0], p[8])):
        key = tuple(sorted((f"{src}:9", f"{dst}:9")))
        now = opened.get(key)
        if now and (flags & 18 == 2 or us - now[1] > idle or us - now[0] > age):
            out.append((*key, *opened.pop(key)))
        start, _, n, total = opened.get(key, (us, us, 0, 0.0))
        opened[key] = (start, us, n + 1, total + size)
        if flags & 5:
            out.append((*key, *opened.pop(key)))
    return sorted([*out, *((*k, *v) for k, v in opened.items())])


def test_batch_and_stream_flows_have_one_age_limit(spark, tmp_path):
    import random

    from tidewatch.sources import readers

    dice, second, rows = random.Random(8), 1_000_000, []
    for k, (src, dst) in enumerate((("a", "b"), ("c", "d"), ("e", "f"))):
        at = 1_000_000 * second
        for _ in range(150 if k else 4000):  # one hot key
            at += dice.choice([1, 1, 2, 5, 9, 16 if k else 3]) * second
            one, two = (src, dst) if dice.random() < 0.6 else (dst, src)
            rows.append((at, one, two, 9, 9, 6, float(dice.randrange(100)), dice.choice([16] * 12 + [2, 1]) if k else 16, len(rows)))
    want = plain_flows(rows, 15 * second, 60 * second)
    frame = spark.createDataFrame(rows, PACKETS)
    shown = lambda df: sorted((r["lo"], r["hi"], r["start"], r["end"], r["packets"], r["bytes"]) for r in df.collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")  # flows that go on from batch to batch
    try:
        assert shown(readers.assemble_flows(frame.repartition(5))) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert max(e - s for _, _, s, e, *_ in want) <= 60 * second
    timed = frame.withColumn("ts", F.timestamp_micros("us")).drop("packet_no")
    timed.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.closable(spark.readStream.schema(timed.schema).parquet(str(tmp_path / "in")), str(tmp_path / "end"))
    assert shown(live.drain(live.flow_stream(stream), "flows", str(tmp_path / "c"), (timed.schema, str(tmp_path / "end")))) == want


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    """Files come one by one; the third holds a row of a window that the watermark has passed."""
    hours = [[0, 1], [10], [1, 11], [20]]
    for i, part in enumerate(hours):
        rows = [(1, h * HOUR, 1.0) for h in part]
        spark.createDataFrame(rows, "scenario long, us long, bytes double").select("scenario", F.timestamp_micros("us").alias("ts"), "bytes", F.lit(0.0).alias("failed_auth")).coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    schema = spark.read.parquet(str(tmp_path / "in0")).schema
    for i in range(len(hours)):  # a run of the stream for each file, on one checkpoint
        import shutil

        folder = tmp_path / "all"
        folder.mkdir(exist_ok=True)
        for f in (tmp_path / f"in{i}").glob("part-*"):
            shutil.copy(f, folder / f"{i}-{f.name}")
        stream = live.windows(spark.readStream.schema(schema).parquet(str(folder)), "1 hour", late="2 hours")
        with live.counting(spark) as counts:
            out = live.drain(stream, "late", str(tmp_path / "c"))
        assert (sum(counts.seen.values()), sum(counts.dropped.values())) == (len(hours[i]), int(i == 2))
    assert {r["start"].hour: r["event_count"] for r in out.collect()} == {0: 1, 1: 1, 10: 1, 11: 1}


def test_history_state_expires(spark, tmp_path):
    """Scenario 1 is silent while scenario 2 goes on 40 days later: what was held of scenario 1 for 30 days is gone."""
    day = 24 * HOUR
    parts = [[(1, 5), (1, 6), (1, 7), (2, 7)], [(2, 47)], [(1, 48), (2, 48)]]
    held = {}
    for part in parts:
        rows = spark.createDataFrame([(s, d * day, float(d)) for s, d in part], "scenario long, us long, bytes double").select("scenario", F.timestamp_micros("us").alias("start"), "bytes")
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        out = live.drain(live.score_history(stream, 3, 30), "held", str(tmp_path / "c"))
        held |= {(r["scenario"], r["us"] // day): r["held"] for r in out.select("scenario", F.unix_micros("start").alias("us"), "held").collect()}
    assert held == {(1, 5): 0, (1, 6): 1, (1, 7): 2, (2, 7): 0, (2, 47): 1, (1, 48): 0, (2, 48): 2}
    assert live.history_score(5.0, [1.0, 2.0, 3.0], 3) == (5.0 - 2.0) / (2 / 3) ** 0.5 and live.history_score(2.0, [1.0, 1.0, 1.0], 3) == 6.0


def test_alert_sink_writes_a_batch_once(spark, tmp_path):
    from tidewatch.sources.sinks import AlertSink, delivered

    rows = [(1, k, f"d{k}", "ddos", 0.9, "high" if k % 2 else "low", True) for k in range(6)]
    frame = spark.createDataFrame(rows, "scenario long, k long, detector string, attack_type string, probability double, severity string, is_alert boolean")
    sink = AlertSink(str(tmp_path / "alerts"))
    sink(frame.where("k < 4"), 0)
    sink(frame.where("k >= 4"), 1)
    first = sorted(map(tuple, delivered(spark, sink.path).collect()))
    sink(frame.where("k >= 4"), 1)  # the batch runs again after a failure
    assert sorted(map(tuple, delivered(spark, sink.path).collect())) == first
    assert [(key, batch) for key, _, batch in first] == [("1:1:d1", 0), ("1:3:d3", 0), ("1:5:d5", 1)]
    # through a stream, restarted from its checkpoint: nothing is delivered again
    frame.coalesce(1).write.parquet(str(tmp_path / "in"))
    other = AlertSink(str(tmp_path / "more"))
    for _ in range(2):
        stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(other).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert [r["key"] for r in delivered(spark, other.path).orderBy("key").collect()] == ["1:1:d1", "1:3:d3", "1:5:d5"]
