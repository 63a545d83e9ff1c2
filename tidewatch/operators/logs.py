"""Append-only logs: current records, allowed transitions, due times, hash chains and access analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import canonical_digest

# Which status may follow which, and hours to resolve by risk.
NEXT_STATUS = {"open": ["in_progress", "closed"], "in_progress": ["resolved", "open"], "resolved": ["closed", "open"], "closed": []}
DUE_HOURS = {"critical": 4, "high": 24, "medium": 72, "low": 168}


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("x")).select(key, "x.*")


def transitions(rows: DataFrame, key: str, order: str, status: str, rules: dict[str, list[str]]) -> DataFrame:
    """rows with the status before and whether the step is allowed; a first record is."""
    before = F.lag(status).over(Window.partitionBy(key).orderBy(order))
    ok = F.lit(False)
    for a, nexts in rules.items():
        ok = F.when(F.col("before") == a, F.col(status).isin(nexts) if nexts else F.lit(False)).otherwise(ok)
    return rows.withColumn("before", before).withColumn("allowed", F.col("before").isNull() | ok)


#: Fixed value: the previous hash of a log's first record.
GENESIS = "0" * 64


def record_hash(fields: dict[str, tuple[Column, str]]) -> Column:
    """The digest of a record: of all its fields, the previous record's hash among them, as canonical JSON."""
    return canonical_digest(fields)


def verify_chain(rows: DataFrame, key: str, order: str, fields: dict[str, tuple[Column, str]]) -> DataFrame:
    """rows (the fields, previous_hash and record_hash) with their place in the log (from 1) and the faults of each record.

    A record's link is to the hash that its predecessor bears, so one altered record makes one bad hash and, if its hash was
    altered too, one bad link.
    """
    over = Window.partitionBy(key).orderBy(order)
    sound = F.col("record_hash") == record_hash(fields)
    expected = F.coalesce(F.lag("record_hash").over(over), F.when(F.row_number().over(over) == 1, F.lit(GENESIS)))
    linked = F.col("previous_hash").eqNullSafe(expected)
    return rows.withColumns({"place": F.row_number().over(over).cast("long"), "bad_hash": ~F.coalesce(sound, F.lit(False)), "bad_link": ~linked})


def ledger_errors(verified: DataFrame, key: str, name: str) -> DataFrame:
    """(key, place, error): a row for each fault of a verified log; ``name`` is the column that names a record."""
    text = lambda what: F.concat(F.lit("record "), F.col("place").cast("string"), F.lit(" ("), F.col(name).cast("string"), F.lit("): " + what))
    faults = F.array_compact(F.array(F.when(F.col("bad_hash"), text("record hash mismatch")), F.when(F.col("bad_link"), text("broken previous-hash link"))))
    return verified.select(key, "place", F.explode(faults).alias("error"))


def ledger_summary(verified: DataFrame, key: str) -> DataFrame:
    """Per log: records checked, errors, and whether it is valid."""
    errors = F.count_if("bad_hash") + F.count_if("bad_link")
    return verified.groupBy(key).agg(F.count("*").alias("records_checked"), errors.alias("errors"), (errors == 0).alias("valid"))


def sla_report(cases: DataFrame, now: Column) -> DataFrame:
    """cases (opened in micros, risk, status): resolved, breached or on track, counted by risk."""
    hours = F.lit(168)
    for r, h in DUE_HOURS.items():
        hours = F.when(F.col("risk") == r, F.lit(h)).otherwise(hours)
    due = F.col("opened") + hours.cast("long") * 3_600_000_000
    state = F.when(F.col("status").isin("resolved", "closed"), "resolved").when(due < now, "breached").otherwise("on_track")
    return cases.groupBy("risk").agg(*[F.count_if(state == s).alias(s) for s in ("on_track", "breached", "resolved")])


def verdict_counts(feedback: DataFrame) -> DataFrame:
    """Counts by verdict, and the share of false positives among all."""
    whole = feedback.agg(F.avg((F.col("verdict") == "false_positive").cast("double")).alias("false_positive_rate"))
    return feedback.groupBy("verdict").agg(F.count("*").alias("n")).join(whole)


def feedback_by(feedback: DataFrame, column: str) -> DataFrame:
    """Verdicts of each value of a column, and the share of false positives among them."""
    kinds = [F.count_if(F.col("verdict") == v).alias(v) for v in ("true_positive", "false_positive", "needs_review")]
    return feedback.groupBy(column).agg(F.count("*").alias("n"), *kinds, F.avg((F.col("verdict") == "false_positive").cast("double")).alias("false_positive_rate"))


def access_summary(audit: DataFrame) -> DataFrame:
    """Requests, denials and last time by key, role and status."""
    return audit.groupBy("key_id", "role", "status").agg(F.count("*").alias("requests"), F.count_if(F.col("status").isin(401, 403)).alias("denied"), F.max("at").alias("last_at"))


def active_keys(records: DataFrame, now: Column) -> DataFrame:
    """The last record (by place) of each key, where it is neither revoked nor expired; a null expiry never comes, one at ``now`` has.

    records: key_id, place, role, expires (micros) and revoked (null: false). Of rows with one place the greatest values count.
    """
    last = records.groupBy("key_id").agg(F.max(F.struct("place", "role", "expires", F.coalesce("revoked", F.lit(False)).alias("revoked"))).alias("last"))
    return last.select("key_id", "last.role", "last.expires", "last.revoked").where(~F.col("revoked") & (F.col("expires").isNull() | (F.col("expires") > now))).drop("revoked")


def allowed(audit: DataFrame, matrix: DataFrame) -> DataFrame:
    """audit with permitted: the role's matrix has a prefix of the path for the method; admin may all."""
    hits = audit.join(matrix, (F.col("role") == F.col("m_role")) & (F.col("method") == F.col("m_method")) & F.col("path").startswith(F.col("prefix")), "left_semi").select("request_id").distinct().withColumn("hit", F.lit(True))
    return audit.join(hits, "request_id", "left").withColumn("permitted", (F.col("role") == "admin") | F.coalesce("hit", F.lit(False))).drop("hit")


def technique_coverage(findings: DataFrame, techniques: DataFrame) -> DataFrame:
    """Count and greatest probability over all findings of every listed technique, and whether it was observed."""
    seen = findings.groupBy("technique").agg(F.count("*").alias("n"), F.max("probability").alias("p"))
    rows = techniques.join(seen, "technique", "left").select("technique", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("p", F.lit(0.0)).alias("max_probability"))
    return rows.withColumn("observed", F.col("max_probability") > 0)


# The colours of an export layer by greatest probability.
COLOURS = [(0.65, "#67000d"), (0.30, "#fb6a4a"), (0.0, "#fff5f0")]


def coverage_layer(coverage: DataFrame) -> DataFrame:
    """(technique, entry): the layer's JSON entry of every observed technique."""
    p, n = F.col("max_probability"), F.col("n")
    colour = F.when(p >= COLOURS[0][0], COLOURS[0][1]).when(p >= COLOURS[1][0], COLOURS[1][1]).otherwise(COLOURS[2][1])
    comment = F.format_string("%d detection(s) | max_prob=%.3f", n, p)
    entry = F.struct(F.col("technique").alias("techniqueID"), F.least(F.lit(10), n).alias("score"), colour.alias("color"), comment.alias("comment"), F.lit(True).alias("enabled"))
    return coverage.where("observed").select("technique", F.to_json(entry).alias("entry"))


def registry_state(log: DataFrame, key: str, order: str) -> DataFrame:
    """Status of each registered version from its log of actions (register, approve, rollback), and how many were refused.

    Only a registered version can be approved, and only an approved one rolled back. A version's log is folded in its order.
    """
    actions = log.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), "action"))).alias("log"))
    state = lambda status, refused: F.struct(F.lit(status).alias("status"), refused.alias("refused"))
    start = F.struct(F.lit(None).cast("string").alias("status"), F.lit(0).alias("refused"))

    def step(now, x):
        a, s, n = x["action"], now["status"], now["refused"]
        bad = F.struct(s.alias("status"), (n + 1).alias("refused"))
        out = F.when((a == "register") & s.isNull(), state("registered", n)).when((a == "approve") & (s == "registered"), state("approved", n))
        return out.when((a == "rollback") & (s == "approved"), state("rolled_back", n)).otherwise(bad)

    return actions.select(key, F.aggregate("log", start, step).alias("x")).select(key, "x.status", "x.refused")


def phase_summary(events: DataFrame) -> DataFrame:
    """By phase: events, bytes, distinct endpoints and a histogram of types."""
    kinds = events.groupBy("phase", "event_type").agg(F.count("*").alias("n"))
    spread = kinds.groupBy("phase").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_type", "n"))), lambda x: F.concat_ws("=", x["event_type"], x["n"])), ",").alias("types"))
    return events.groupBy("phase").agg(F.count("*").alias("events"), F.sum("bytes").alias("bytes"), F.count_distinct("dst").alias("endpoints")).join(spread, "phase")


def phase_traffic(events: DataFrame) -> DataFrame:
    """By phase: bytes sent and received (null counts as 0), and a histogram of HTTP statuses, an absent one as 0.

    The histogram is counted by status first, so the text that is put together is as long as there are statuses.
    """
    code = F.coalesce(F.col("http_status").cast("int"), F.lit(0))
    counts = events.groupBy("phase", code.alias("code")).agg(F.count("*").alias("n"), F.sum(F.coalesce("bytes_sent", F.lit(0.0))).alias("sent"), F.sum(F.coalesce("bytes_received", F.lit(0.0))).alias("received"))
    pairs = F.array_sort(F.collect_list(F.struct("code", "n")))
    return counts.groupBy("phase").agg(F.sum("n").alias("events"), F.sum("sent").alias("bytes_sent"), F.sum("received").alias("bytes_received"), F.array_join(F.transform(pairs, lambda x: F.concat_ws("=", x["code"], x["n"])), ",").alias("statuses"))


def request_latency(requests: DataFrame) -> DataFrame:
    """By status code: requests, and the sum and count of their latencies in ms; requests without one aren't in the latter."""
    return requests.groupBy("status").agg(F.count("*").alias("requests"), F.sum("latency_ms").alias("latency_ms_sum"), F.count("latency_ms").alias("latency_ms_count"))
