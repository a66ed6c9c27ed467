"""Whole-reply validation against plain loops, and small inputs with nulls, ties, repeats and empty tables."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from planwalk.functions import geometry
from planwalk.operators import reports, shapes, tables
from planwalk.operators.objects import STATUS_HOPS
from planwalk.sources import svg


def test_status_changes_equal_a_loop(spark):
    rng = random.Random(5)
    names = [*reports.STATUSES, "DRAFT", None]
    objects = {k: rng.choice(names) for k in range(12)}
    asked = [(rng.randint(0, 14), rng.randint(1, 30), rng.choice(names)) for _ in range(400)]
    found = reports.status_changes(spark.createDataFrame(asked, "uso_id long, ord long, wanted string"), spark.createDataFrame(list(objects.items()), "uso_id long, status string")).collect()
    wanted = collections.Counter()
    now = dict(objects)
    for k, ord_, status in sorted(asked, key=lambda a: (a[0], a[1], a[2] is not None, a[2] or "")):
        before = now.get(k)
        ok = (before, status) in STATUS_HOPS
        wanted[(k, ord_, status, before, ok)] += 1
        now[k] = status if ok else before
    assert collections.Counter((r["uso_id"], r["ord"], r["wanted"], r["before"], r["accepted"]) for r in found) == wanted


def test_digests_of_lists_equal_those_of_prefixes(spark):
    routes = spark.createDataFrame([(1, "a"), (2, None), (3, "z")], "route_id long, origin string")
    segments = spark.createDataFrame([(1, 1, "b"), (1, 2, "a"), (1, 3, "c"), (2, 1, "b"), (2, 2, None)], "route_id long, sequence long, target string")
    told = spark.createDataFrame(
        [(1, 0, ["a"], True), (1, 2, ["a", "b", "a"], True), (1, 2, ["b", "a", "a"], False), (1, 3, ["a", "b", "a"], False), (1, 3, ["a", "b", "a", "c"], True), (2, 2, [None, "b", None], True), (2, 2, ["b", None, None], False), (3, 0, ["z"], True), (3, 0, [], False)],
        "route_id long, step long, visited array<string>, same boolean",
    )
    rows = told.join(reports.visited_prefixes(segments, routes), ["route_id", "step"]).select("same", reports.visited_digest(F.col("visited")).eqNullSafe(F.col("expected")).alias("found")).collect()
    assert len(rows) == 9 and all(r["same"] == r["found"] for r in rows)


def snapshot(**changes):
    row = {"k": 1, "session": 1, "route": 7, "step": 1, "total": 2, "state": "ACTIVE", "current_node": "b", "current_segment": 1, "remaining_segments": 1, "remaining_cost": 2.0, "remaining_distance": 2.0, "percentage": 50.0, "completed": False, "visited": ["a", "b"]}
    return row | changes


SHOT = "k long, session long, route long, step long, total long, state string, current_node string, current_segment long, remaining_segments long, remaining_cost double, remaining_distance double, percentage double, completed boolean, visited array<string>"


@pytest.mark.parametrize(
    "changes, told",
    [
        ({}, []),
        ({"visited": None}, ["visited_missing"]),
        ({"visited": []}, ["visited_missing"]),
        ({"visited": ["b", "b"]}, ["visited_duplicates", "visited_wrong"]),
        ({"visited": ["b", "a"]}, ["visited_end", "visited_wrong"]),
        ({"visited": ["b"]}, ["visited_wrong"]),
        ({"route": 8}, ["visited_wrong"]),
        ({"remaining_distance": float("nan")}, ["remaining_distance"]),
        ({"remaining_distance": None}, ["remaining_distance"]),
        ({"completed": True}, ["completed_below_100", "completed_with_cost", "completed_with_distance", "completed_with_segments"]),
    ],
)
def test_faults_of_one_snapshot(spark, changes, told):
    segments = spark.createDataFrame([(7, 1, "b"), (7, 2, "c")], "route_id long, sequence long, target string")
    routes = spark.createDataFrame([(7, "a")], "route_id long, origin string")
    row = snapshot(**changes)
    shots = spark.createDataFrame([tuple(row[c.split()[0]] for c in SHOT.split(", "))], SHOT)
    events = spark.createDataFrame([], "k long, place long, event_type string, event_session long, event_route long")
    found = reports.session_audit(shots, reports.visited_prefixes(segments, routes), events, "k").collect()
    assert sorted(r["check_name"] for r in found) == told


def test_reports_of_null_keys_and_of_nothing(spark):
    faults = spark.createDataFrame([("a", 1), ("a", None), ("mild", 2), ("b", 1)], "check_name string, k long")
    subjects = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (None, "n")], "k long, label string")
    found = {r["k"]: (r["label"], r["valid"], r["n_errors"], r["n_warnings"]) for r in reports.reports(faults, subjects, "k", warnings=("mild",)).collect()}
    assert found == {1: ("x", False, 2, 0), 2: ("y", True, 0, 1), 3: ("z", True, 0, 0), None: ("n", False, 1, 0)}
    assert reports.reports(faults, subjects.limit(0), "k").collect() == []
    assert {r["valid"] for r in reports.reports(faults.limit(0), subjects, "k").collect()} == {True}


@pytest.mark.parametrize(
    "text, reason",
    [
        ('{"type":"Point","coordinates":{"x":1,"y":-2.5e3}}', None),
        ('{"type":"Point","coordinates":{"x":1,"y":"2"}}', "point"),
        ('{"type":"Point","coordinates":{"x":true,"y":2}}', "point"),
        ('{"type":"Point"}', "point"),
        ('{"type":"Line","coordinates":[{"x":1,"y":2},{"x":1,"y":2,"z":3}]}', None),
        ('{"type":"Line","coordinates":[{"x":1,"y":2}]}', "points"),
        ('{"type":"Line","coordinates":{"x":1,"y":2}}', "points"),
        ('{"type":"Polygon","coordinates":[{"x":1,"y":2},{"x":1,"y":2},{"x":0,"y":0}]}', None),
        ('{"type":"Polygon","coordinates":[{"x":1,"y":2},{"x":1,"y":2},null]}', "points"),
        ('{"type":"point","coordinates":{"x":1,"y":2}}', "type"),
        ('{"coordinates":{"x":1,"y":2}}', "type"),
        ("[]", "type"),
        ("null", "missing"),
        ('"Point"', "missing"),
        ("", "missing"),
        (None, "missing"),
    ],
)
def test_reasons_of_geometries(spark, text, reason):
    assert spark.createDataFrame([(text,)], "t string").select(geometry.geometry_reason(F.col("t"))).collect()[0][0] == reason


def test_canonical_models_of_documents(spark):
    files = [
        (1, '<svg viewBox="5 6 10 20" width="3cm"><g id="b"><line id="l" x1="1"/></g><g id="a"><rect/><g><circle id="c"/></g></g><text id="t">hi <b>x</b></text><g id="b"><path id="p"/></g></svg>'),
        (2, "<svg>"),
        (3, None),
        (4, "<svg><line/></svg>"),
    ]
    found = {r["import_id"]: r for r in svg.canonical_models(spark.createDataFrame(files, "import_id long, content string")).collect()}
    one = found[1]
    assert (one["status"], one["message"], one["layers"]) == ("NORMALIZED", None, ["b", "a"])
    assert one["coordinate_system"].asDict(True) == {"origin": {"x": 5.0, "y": 6.0}, "units": "cm", "rotation": 0, "scale": 1}
    assert tuple(one["bounds"]) == (5.0, 6.0, 15.0, 26.0)
    assert [(e["id"], e["type"], e["layer"], e["text"]) for e in one["elements"]] == [("l", "line", "b", None), ("el-1", "rect", "a", None), ("c", "circle", "a", None), ("t", "text", None, "hi "), ("p", "path", "b", None)]
    assert one["elements"][0]["attributes"] == {"id": "l", "x1": "1"}
    assert [tuple(r) for r in one["relationships"]] == [("CONTAINS", "b", "l"), ("CONTAINS", "b", "p"), ("CONTAINS", "a", "el-1"), ("CONTAINS", "a", "c")]
    for k in (2, 3):
        assert found[k]["status"] == "FAILED" and found[k]["message"] and found[k]["elements"] is None and found[k]["coordinate_system"] is None
    assert (found[4]["layers"], found[4]["relationships"], len(found[4]["elements"])) == ([], [], 1)


def test_audits_of_empty_tables(spark):
    empty = lambda schema: spark.createDataFrame([], schema)
    none = reports.production_audit(
        empty("ord long, batch_id long, uso_id long, model_id long, collection string, candidate_id string, reference string, status string"),
        empty("model_id long, collection string, candidate_id string"),
        empty("ord long, batch_id long, src long, dst long, relation string"),
    )
    assert none.collect() == []
    graphs = spark.createDataFrame([(1,), (1,)], "graph_id long")
    found = reports.detection_audit(graphs, empty("graph_id long, model_id long, uso_id long"), empty("ord long, graph_id long, model_id long, candidate_type string")).collect()
    assert sorted(tuple(r) for r in found) == [("no_detections", 1, None), ("no_models", 1, None)]


def test_geometry_models_of_plans(spark):
    """A plan of which nothing is left, repeated shapes, and a row per plan whatever its candidates."""
    schema = "import_id long, ord long, id string, type string, layer string, x double, y double, w double, h double, r double, x2 double, y2 double"
    rows = [
        (1, 1, "a", "line", None, 0.0, 0.0, None, None, None, 10.0, 0.0),
        (1, 2, "b", "line", None, 0.0, 0.0, None, None, None, 10.0, 0.0),
        (1, 3, "c", "rect", "L", 50.0, 50.0, 4.0, 2.0, None, None, None),
        (1, 4, "d", "circle", "L", 0.0, 0.0, None, None, 0.0, None, None),
        (2, 5, "e", "line", None, 1.0, 1.0, None, None, None, 1.0, 1.0),
    ]
    given = spark.createDataFrame(rows, schema)
    topology = shapes.Topology(shapes.clean(given))
    found = {r["import_id"]: r for r in shapes.geometry_models(given, topology, shapes.candidates(topology)).collect()}
    one, two = found[1], found[2]
    assert [s["id"] for s in one["shapes"]] == ["a", "c"]
    assert one["warnings"] == ["circle 'd' removed: zero-length or degenerate", "line 'b' removed: duplicate"]
    assert [(n["node_no"], n["x"], n["y"], n["degree"]) for n in one["nodes"]] == [(1, 0.0, 0.0, 1), (2, 10.0, 0.0, 1), (3, 50.0, 50.0, 2), (4, 54.0, 50.0, 2), (5, 54.0, 52.0, 2), (6, 50.0, 52.0, 2)]
    assert [(e["id"], e["seg"], e["from_node"], e["to_node"]) for e in one["edges"]] == [("a", 0, 1, 2), ("c", 0, 3, 4), ("c", 1, 4, 5), ("c", 2, 5, 6), ("c", 3, 6, 3)]
    assert [c["candidate_type"] for c in one["candidates"]] == ["BOUNDARY", "ENCLOSURE", "PASSAGE"]
    assert tuple(one["box"]) == (0.0, 0.0, 54.0, 52.0)
    assert (two["shapes"], two["nodes"], two["edges"], two["candidates"], two["box"]) == ([], [], [], [], None)
    assert two["warnings"] == ["line 'e' removed: zero-length or degenerate"]


def test_reasons_of_uploads(spark):
    files = [(1, "image/svg+xml", 0), (2, "image/svg+xml", 101), (3, "image/png", 5), (4, None, 5), (5, "image/svg+xml", None), (5, "image/svg+xml", None), (6, "image/svg+xml", 100)]
    rows = spark.createDataFrame(files, "k long, mime string, length long")
    found = tables.upload_reasons(rows, ("image/svg+xml",), 100).collect()
    assert sorted((r["k"], r["reason"] or "") for r in found) == [(1, ""), (2, "too_large"), (3, "unsupported_type"), (4, "unsupported_type"), (5, "no_file"), (5, "no_file"), (6, "")]
    taken, refused = tables.accepted_files(rows, ("image/svg+xml",), 100)
    assert sorted(r["k"] for r in taken.collect()) == [1, 6] and refused.count() == 5


def test_events_of_snapshots_that_follow_positions(spark):
    states = spark.createDataFrame([(1, 1, 7, "ACTIVE", True), (2, 1, 7, "ACTIVE", False), (3, 1, 7, "ACTIVE", None)], "k long, session long, route long, state string, completed boolean")
    events = spark.createDataFrame(
        [(2, 0, "NodeReached", 1, 7), (2, 1, "SegmentEntered", 1, 8), (2, 2, "DestinationReached", None, 7), (3, 0, "Left", 1, None), (3, 1, "Left", 2, 7), (9, 0, "Left", 1, 7)],
        "k long, place long, event_type string, event_session long, event_route long",
    )
    found = reports.event_faults(events, states, "k", must_end=True).collect()
    told = {("completed_without_destination", 1, None), ("order", 2, 1), ("other_route", 2, 1), ("other_session", 2, 2), ("destination_not_completed", 2, None)}
    told |= {("unsupported_type", 3, 0), ("unsupported_type", 3, 1), ("duplicate_type", 3, 1), ("other_route", 3, 0), ("other_session", 3, 1)}
    assert {tuple(r) for r in found} == told and len(found) == len(told)


def test_no_table_of_calls_is_broadcast(spark, tmp_path):
    """Repeated columns make small files of many rows; such tables were sent whole to the driver."""
    n = 300_000
    calls = spark.range(n).select(F.col("id").alias("k"))
    same = {"session": F.lit(1).cast("long"), "route": F.lit(7).cast("long"), "state": F.lit("ACTIVE"), "completed": F.lit(False)}
    calls.withColumns(same).write.parquet(f"{tmp_path}/shots")
    told = {"place": F.lit(0).cast("long"), "event_type": F.lit("SessionStarted"), "event_session": F.lit(1).cast("long"), "event_route": F.lit(7).cast("long")}
    calls.withColumns(told).write.parquet(f"{tmp_path}/events")
    shots, events = (spark.read.parquet(f"{tmp_path}/{t}") for t in ("shots", "events"))
    faults = reports.event_faults(events, shots, "k")
    for df in (faults, reports.reports(faults, shots.select("k"), "k")):
        assert df.count() in (0, n)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan()
        assert "Broadcast" not in plan.toString() and "SortMergeJoin" in plan.toString()


def test_reports_of_sessions_broadcast_no_calls(spark, tmp_path):
    """The audit of a session's snapshots meets their prefixes and events by sorting, whatever the size of the files."""
    told = {"session": F.lit(1).cast("long"), "route": F.lit(7).cast("long"), "step": F.lit(1).cast("long"), "total": F.lit(2).cast("long"), "state": F.lit("ACTIVE"), "current_node": F.lit("b"), "current_segment": F.lit(1).cast("long"), "remaining_segments": F.lit(1).cast("long")}
    told |= {"remaining_cost": F.lit(2.0), "remaining_distance": F.lit(2.0), "percentage": F.lit(50.0), "completed": F.lit(False), "visited": F.array(F.lit("a"), F.lit("b"))}
    spark.range(5000).withColumnRenamed("id", "k").withColumns(told).write.parquet(f"{tmp_path}/shots")
    shots = spark.read.parquet(f"{tmp_path}/shots")
    prefixes = reports.visited_prefixes(spark.createDataFrame([(7, 1, "b"), (7, 2, "c")], "route_id long, sequence long, target string"), spark.createDataFrame([(7, "a")], "route_id long, origin string"))
    events = spark.createDataFrame([(1, 0, "Left", 1, 7)], "k long, place long, event_type string, event_session long, event_route long")
    faults = reports.session_audit(shots, prefixes, events, "k")
    found = reports.reports(faults, shots.select("k"), "k")
    assert found.where("NOT valid").select("k", "n_errors").collect() == [(1, 1)]
    found.write.format("noop").mode("overwrite").save()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
