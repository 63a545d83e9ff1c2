"""Correlation against brute force over all alerts of the smallest tables."""

import pytest

from tidewatch.operators import correlate as C
from tidewatch.queries import detect

SF = "/root/testdata/sf0.001"
LATE_STAGES = {"command_and_control", "exfiltration", "phishing", "malware_activity"}


@pytest.fixture(scope="module")
def alerts(spark):
    return detect.alerts(spark, SF).collect()


def test_chains_hold_all_detectors(spark, alerts):
    assert LATE_STAGES & {r["detector"] for r in alerts}
    chain, before, want = {}, {}, []
    for r in sorted(alerts, key=lambda r: (r["scenario"], r["start"], -r["probability"], r["attack_type"])):
        s = r["scenario"]
        chain[s] = chain.get(s, 0) + (s in before and r["start"] - before[s] > detect.GAP)
        before[s] = r["end"]
        want.append((s, r["k"], r["detector"], chain[s]))
    got = [(r["scenario"], r["k"], r["detector"], r["chain"]) for r in detect.chained(spark, SF).collect()]
    assert sorted(got) == sorted(want)
    assert sum(r["findings"] for r in detect.j1(spark, SF).collect()) == len(alerts)


def test_transition_lookup_holds_all_detectors(spark, alerts):
    want = {(r["scenario"], r["k"], r["attack_type"], nxt, p) for r in alerts for cur, nxt, p in C.NEXT_TRANSITIONS if cur == r["attack_type"]}
    assert {tuple(r) for r in detect.c13(spark, SF).collect()} == want


def test_technique_paths_of_bundles(spark):
    """A cycle, an action without a technique, an open branch, nested conditions, and nodes that two ways share."""
    import json

    from tidewatch.operators import correlate as C

    def action(i, technique, *refs):
        return {"id": i, "type": "attack-action", "technique_id": technique, "effect_refs": list(refs)}

    def condition(i, true, false=()):
        return {"id": i, "type": "attack-condition", "on_true_refs": list(true), "on_false_refs": list(false)}

    def operator(i, *refs):
        return {"id": i, "type": "attack-operator", "effect_refs": list(refs)}

    def flow(*refs):
        return {"id": "flow", "type": "attack-flow", "start_refs": list(refs)}

    bundles = {
        "plain": [flow("a"), action("a", "T1", "b"), action("b", None, "c"), action("c", "T3")],
        "cycle": [flow("a"), action("a", "T1", "b", "d"), action("b", "T2", "a"), action("d", "T4")],
        "only cycle": [flow("a"), action("a", "T1", "b"), action("b", "T2", "a")],
        "branches": [flow("c0"), condition("c0", ["a"], ["o"]), operator("o", "b", "c1"), condition("c1", ["b"], ["x"]), action("a", "T1"), action("b", "T2")],
        "conditions in a ring": [flow("a"), action("a", "T1", "c0"), condition("c0", ["c1"], ["b"]), condition("c1", ["c0", "b"]), action("b", "T2")],
        "one condition for two": [flow("a"), action("a", "T1", "c"), condition("c", ["b"], ["d"]), action("b", "T2", "c"), action("d", "T3")],
        "nameless": [flow("a", "a"), action("a", "")],
        "twice": [flow("a", "a"), action("a", "T9"), action("a", "T8")],
        "empty": [],
    }
    frame = spark.createDataFrame([(k, json.dumps({"objects": v})) for k, v in bundles.items()], "bundle string, json string")
    got = sorted((r["bundle"], ">".join(r["techniques"])) for r in C.technique_paths(frame).collect())

    def plain(objects):
        """Depth-first search by the definition."""
        nodes, out = {o["id"]: o for o in objects}, []

        def go(i, path, seen):
            if i in seen or i not in nodes:
                return
            o = nodes[i]
            path = [*path, o["technique_id"]] if o.get("technique_id") else path
            refs = o.get("on_true_refs", []) + o.get("on_false_refs", []) + o.get("effect_refs", [])
            for r in refs:
                go(r, path, seen | {i})
            if o["type"] == "attack-action" and not refs and path:
                out.append(">".join(path))

        for o in objects:
            for r in o.get("start_refs", []):
                go(r, [], frozenset())
        return out

    assert got == sorted((k, p) for k, v in bundles.items() for p in plain(v))
    assert ("cycle", "T1>T4") in got and ("plain", "T1>T3") in got and "only cycle" not in dict(got)
    assert C.technique_paths(frame.where("bundle = 'none'")).count() == 0
