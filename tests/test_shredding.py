import json
import random

import numpy as np

from tallyforge.operators import shredding
from tallyforge.operators.shredding import Node, Shredder


def wrap(kind, body, channel="impressionEventValueValue", bare=False):
    inner = {kind: body if bare else {"value": body}}
    return {channel: {"value": {"v1EventValueValue": {"value": inner}}}}


def table(spark, rows, which):
    df = spark.createDataFrame(rows, "row_id bigint, payload string, event_pos string, assetId string")
    return [tuple(r) for r in shredding.shred_viewport(df, which).collect()]


def test_shapes_of_lists_and_wrappers(spark):
    c = lambda a: {"campaign": {"assetId": a, "flightId": "f"}}
    rows = [
        (1, wrap("containerViewValueValue", {"elements": [c("a"), {}, None, c(7)]})),
        (2, wrap("containerViewValueValue", {"elements": c("lone")}, bare=True)),
        (3, [wrap("interactionValueValue", {"elements": {"value": [c("x")]}, **c("own")}, "engagementEventValueValue"), None, wrap("inputValueValue", {"elements": {"value": c("y")}}, "engagementEventValueValue")]),
        (4, wrap("containerViewValueValue", {"elements": None, "campaign": None})),
        (5, wrap("containerViewValueValue", {"elements": [{"campaign": {"assetId": None}}, {"campaign": {"assetId": ""}}, {"campaign": {}}]})),
        (6, {}), (7, []), (8, 5), (9, {"other": 1}),
    ]
    texts = [(i, json.dumps(v), "", "") for i, v in rows]
    texts += [(10, json.dumps(json.dumps(rows[0][1])), "", ""), (11, None, "", ""), (12, "", "", ""), (13, texts[0][1][:40], "", ""), (1, texts[0][1], "", ""), (14, "[" * 50000, "", "")]
    got = sorted((r[0], r[1], r[2], r[3]) for r in table(spark, texts, "campaigns") if r[3])
    one = [(0, 0, "a"), (0, 3, "7")]
    assert got == sorted([(1, *x) for x in one * 2] + [(10, *x) for x in one] + [(2, 0, 0, "lone"), (3, 0, -1, "own"), (3, 0, 0, "x"), (3, 2, 0, "y")])
    elements = [(r[0], r[1], r[2]) for r in table(spark, texts[:1], "elements")]
    assert elements == [(1, 0, 0), (1, 0, 1), (1, 0, 3)]
    kinds = {(r[0], r[1]): r[2] for r in table(spark, texts[:3], "events")}
    assert kinds == {(1, 0): "containerViewValueValue", (2, 0): "containerViewValueValue", (3, 0): "interactionValueValue", (3, 2): "inputValueValue"}
    unreadable = shredding.unreadable_payloads(spark.createDataFrame(texts, "row_id bigint, payload string, event_pos string, assetId string"))
    assert sorted(r[0] for r in unreadable.collect()) == [8, 11, 12, 13, 14]


def test_empty(spark):
    for which in shredding.SCHEMAS:
        assert table(spark, [], which) == []


def test_levels_round_trip():
    """What the levels of a doubly repeated leaf say is enough to rebuild the lists."""
    schema = Node("a", repeated=True, wrapped=False, children=(Node("b", repeated=True, wrapped=False, children=(Node("c", wrapped=False),)),))
    r = random.Random(3)
    records = [[{"b": [{"c": str(r.random())} if r.random() < 0.8 else {} for _ in range(r.randrange(4))]} for _ in range(r.randrange(1, 4))] for _ in range(200)]
    s = Shredder(schema)
    s.shred(records)
    leaf = s.leaves[("a", "b", "c")]
    reps, defs = np.array(leaf.reps), np.array(leaf.defs)
    record, (first, second) = shredding.ordinals(reps, 2)
    values = iter(leaf.values)
    rebuilt = [[] for _ in records]
    for i, a, b, d in zip(record, first, second, defs):
        while len(rebuilt[i]) <= a:
            rebuilt[i].append({"b": []})
        if d >= 2:
            assert len(rebuilt[i][a]["b"]) == b
            rebuilt[i][a]["b"].append({"c": next(values)} if d == leaf.max_def else {})
    assert rebuilt == records


def test_fields_without_a_column_are_kept(spark):
    body = {"deviceId": "d", "experiments": {"value": [{"experimentId": "x"}]}, "odd": None, "elements": [{"elementId": "e", "note": 1}, {"elementId": "f"}]}
    rows = [(1, json.dumps(wrap("pageViewValueValue", body)), "", ""), (2, json.dumps(wrap("pageViewValueValue", {"deviceId": "d"})), "", "")]
    assert [(r[0], json.loads(r[-1]) if r[-1] else None) for r in table(spark, rows, "events")] == [(1, {"experiments": {"value": [{"experimentId": "x"}]}, "odd": None}), (2, None)]
    assert [r[3:] for r in table(spark, rows, "elements")] == [("e", None, None, None, '{"note": 1}'), ("f", None, None, None, None)]


def test_null_names_before_the_filled_one(spark):
    body = {"elements": [{"campaign": {"assetId": "a"}}]}
    full = wrap("containerViewValueValue", body)
    inner = full["impressionEventValueValue"]["value"]["v1EventValueValue"]["value"]
    one = {"engagementEventValueValue": None, **full}
    two = {"engagementEventValueValue": {"value": None}, "impressionEventValueValue": {"value": {"v1EventValueValue": {"value": {"interactionValueValue": None, **inner}}}}}
    three = wrap("containerViewValueValue", None)
    rows = [(i, json.dumps(v), "", "") for i, v in enumerate((one, two, three))]
    assert sorted(r[:4] for r in table(spark, rows, "campaigns") if r[3]) == [(0, 0, 0, "a"), (1, 0, 0, "a")]
    assert {r[0]: r[2] for r in table(spark, rows[:2], "events")} == {0: "containerViewValueValue", 1: "containerViewValueValue"}
