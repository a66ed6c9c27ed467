"""Hand-made cases of the operators, with the values that their rules give."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from planwalk.functions import geometry as g
from planwalk.operators import graphs, objects, positioning, routing, sessions, shapes, tables
from planwalk.operators.components import connected_components
from planwalk.sources import svg


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def text(v):
    return F.lit(v).cast("string")


@pytest.mark.parametrize(("value", "wanted"), [(-0.0005, 0.0), (0.0005, 0.001), (-2.5, -2.5), (1.23456, 1.235)])
def test_half_up(spark, value, wanted):
    assert one(spark, g.half_up(F.lit(value))) == wanted


@pytest.mark.parametrize(("value", "wanted"), [("12px", 12.0), ("", None), (None, None), ("-.5e1x", -5.0), ("px", None)])
def test_prefix_number(spark, value, wanted):
    assert one(spark, g.prefix_number(text(value))) == wanted


def test_lengths_points_and_areas(spark):
    assert one(spark, g.length_with_unit(F.lit("12.5mm"))).asDict() == {"value": 12.5, "unit": "mm"}
    assert one(spark, g.length_with_unit(F.lit("7")))["unit"] == "px"
    assert one(spark, g.length_with_unit(F.lit("wide"))) is None
    points = g.point_list(F.lit("0,0 10,0 10,10 0,10"))
    assert one(spark, g.polygon_area(points)) == 100.0
    assert one(spark, F.size(g.segments_of(points, close=True))) == 4
    assert one(spark, g.point_list(F.lit("1,2 3"))) == []
    assert one(spark, g.polygon_wkt(points)).startswith("POLYGON((0.0 0.0") and one(spark, F.size(g.open_ring(g.close_ring(points)))) == 4


def test_rolling_hash(spark):
    assert one(spark, g.rolling_hash(F.lit("abc"))) == 96354
    assert [one(spark, c) for c in g.hash_coordinates(F.lit("abc"))] == [54, 63]


def shape_rows(spark, rows):
    return spark.createDataFrame(rows, "import_id long, ord long, id string, type string, layer string, x double, y double, w double, h double, r double, x2 double, y2 double")


def line(k, x, y, x2, y2):
    return (1, k, f"el-{k}", "line", None, x, y, x2 - x, y2 - y, None, x2, y2)


def test_square_of_four_lines_is_one_cycle(spark):
    s = shape_rows(spark, [line(0, 0.0, 0.0, 10.0, 0.0), line(1, 10.0, 0.0, 10.0, 10.0), line(2, 10.0, 10.0, 0.0, 10.0), line(3, 0.0, 10.0, 0.0, 0.0)])
    assert [r["n_edges"] for r in shapes.cycles(s).collect()] == [4]
    assert {r["component"] for r in shapes.shape_components(s).collect()} == {0}
    nodes, edges = shapes.nodes(s).withColumnRenamed("node_no", "node"), shapes.edges(s)
    area = shapes.trace_ring(nodes.select(F.lit(1).alias("component"), "node", "x", "y"), edges.select(F.lit(1).alias("component"), F.col("from_node").alias("a"), F.col("to_node").alias("b")))
    assert [r["area"] for r in area.collect()] == [100.0]
    assert shapes.openings(s).count() == 0


def test_three_sides_leave_an_opening(spark):
    s = shape_rows(spark, [line(0, 0.0, 0.0, 10.0, 0.0), line(1, 10.0, 0.0, 10.0, 10.0), line(2, 10.0, 10.0, 0.0, 10.0)])
    assert [r["gap_width"] for r in shapes.openings(s).collect()] == [10.0]


def test_touching_needs_an_end(spark):
    tee = shape_rows(spark, [line(0, 0.0, 0.0, 10.0, 0.0), line(1, 5.0, 0.5, 5.0, 9.0)])
    cross = shape_rows(spark, [line(0, 0.0, 0.0, 10.0, 10.0), line(1, 0.0, 10.0, 10.0, 0.0)])
    assert shapes.touching_pairs(tee).count() == 1 and shapes.touching_pairs(cross).count() == 0


def test_thin_and_lone_shapes(spark):
    rect = lambda k, w, h: (k, k, f"el-{k}", "rect", None, 0.0, 0.0, w, h, None, None, None)
    s = shape_rows(spark, [rect(0, 40.0, 10.0), rect(1, 39.0, 10.0), line(5, 0.0, 0.0, 1.0, 0.0)[0:0] or (9, 9, "el-9", "line", None, 0.0, 0.0, 5.0, 0.0, None, 5.0, 0.0)])
    assert {(r["id"], r["kind"]) for r in shapes.walls_and_passages(s).collect()} == {("el-0", "passage"), ("el-9", "passage")}


def test_rejects(spark):
    rows = [(1, 0, "a", "rect", None, None, 0.0, 1.0, 1.0, None, None, None), (1, 1, "b", "rect", None, 0.0, 0.0, 0.0, 1.0, None, None, None), (1, 2, "c", "circle", "L", 0.0, 0.0, None, None, 2.0, None, None), (1, 3, "d", "circle", "L", 0.0, 0.0, None, None, 2.0, None, None)]
    assert [r["reason"] for r in shapes.with_reason(shape_rows(spark, rows)).orderBy("ord").collect()] == ["missing or malformed", "zero-length or degenerate", None, "duplicate"]


def traced(spark, *ds):
    """Segments and closedness of each path."""
    rows = spark.createDataFrame([(1, k, d) for k, d in enumerate(ds)], "import_id long, ord long, d string")
    out = {k: ([], False) for k in range(len(ds))}
    for r in svg.path_segments(rows).orderBy("ord", "seg").collect():
        assert r["seg"] == len(out[r["ord"]][0])
        out[r["ord"]] = ([*out[r["ord"]][0], (r["x1"], r["y1"], r["x2"], r["y2"])], r["closed"])
    return [out[k] for k in range(len(ds))]


def test_path_segments(spark):
    cases = {"M0 0 L10 0 M20 0 L30 0": 3, "M0 0 C1 1 2 2 3 3": 1, "M0 0 h5 v5 z": 3, "": 0, None: 0, "M0 0 1 1 2 2": 2}
    assert [len(found) for found, _ in traced(spark, *cases)] == list(cases.values())


def test_path_details(spark):
    later, closed = traced(spark, "M0 0 L10 0 M20 0 L30 0", "m1 1 l2 0 z")
    assert later[0][1] == (10.0, 0.0, 20.0, 0.0)
    assert closed == ([(1.0, 1.0, 3.0, 1.0), (3.0, 1.0, 1.0, 1.0)], True)


def chain(*points):
    return [(*map(float, a), *map(float, b)) for a, b in zip(points, points[1:], strict=False)]


def test_path_points_by_hand(spark):
    cases = {
        "L5 5 h-2": chain((0, 0), (5, 5), (3, 5)),  # draws before any move
        "l1 1 m2 2 l1 0": chain((0, 0), (1, 1)) + chain((3, 3), (4, 3)),  # a relative move from what was drawn; the first move is silent
        "M1 1 l1 0 V9 h1 H0 v-1": chain((1, 1), (2, 1), (2, 9), (3, 9), (0, 9), (0, 8)),
        "m1 1 h1 z l2 0 z m5 5 v1 z h1": chain((1, 1), (2, 1), (1, 1), (3, 1), (1, 1), (6, 6), (6, 7), (6, 6), (7, 6)),
        "M10 10 h5 m1 1 1 1 m1 1 l-1 0": chain((10, 10), (15, 10), (16, 11), (17, 12), (18, 13), (17, 13)),
        "M1 2 C 9 9 8 8 3 4 s7 7 1 1 Q0 0,5 5 t.5.5 a1 1 0 0 1 2 2": chain((1, 2), (3, 4), (4, 5), (5, 5), (5.5, 5.5), (7.5, 7.5)),
        "M0,0L1e1,-2.5E-1 5": chain((0, 0), (10, -0.25)),  # a number too many counts for nothing
        "z": [(0.0,) * 4], "M": [], "M3 3": [], "hello": [(0.0,) * 4][:0], "M1 1 L": [], "m1 1 V4 z m2 0 h1 V0 z": chain((1, 1), (1, 4), (1, 1), (3, 1), (4, 1), (4, 0), (3, 1)),
    }
    found = traced(spark, *cases)
    assert [f for f, _ in found] == list(cases.values())
    assert [c for _, c in found] == ["z" in d and bool(want) for d, want in cases.items()]


def test_long_paths_take_linear_work(spark):
    found = traced(spark, "M0 0" + "l1 0 0 1" * 30_000 + "z")[0]
    assert len(found[0]) == 60_001 and found[0][-1] == (30_000.0, 30_000.0, 0.0, 0.0) and found[1]


SHAPES = (
    b'<svg><line id="a" x1="0" y1="0" x2="3.0005px" y2="4"/><rect id="b" x="1" y="1" width="2" height="3"/><circle id="c" cx="5" cy="5" r="2"/><ellipse id="d" cx="5" cy="5" rx="2" ry="1"/>'
    b'<polyline id="e" points="0,0 1,0 1,1"/><polygon id="f" points="0 0 4 0 4 3"/><path id="g" d="M0 0 h2 v2 z"/><text id="h" x="1" y="2">t</text>'
    b'<rect id="i" x="1" y="1" width="-2" height="3"/><polygon id="j" points="0 0 1 1"/><polyline id="k" points="0 0 1"/><polyline id="l" points="2,2 2,2"/><path id="m" d="M1 1"/><ellipse id="n" cx="1" cy="1" rx="2" ry="0"/>'
    b'<path id="o" d="M9 9 h1 v1 h1"/><path id="p" d="M50 50 v1 v1 v1"/><polygon id="q" points="0,0,4,0,4,3"/><line id="r" x1="0" y1="0" x2="1"/><text id="s" x="1"/></svg>'
)


def test_shapes_of_all_kinds(spark):
    rows = svg.drawn(svg.elements(spark.createDataFrame([(1, SHAPES)], "import_id long, content binary")))
    found = {r["id"]: r for r in shapes.with_reason(rows).collect()}
    assert {k: len(r["segments"]) for k, r in found.items() if r["reason"] is None} == {"a": 1, "b": 4, "c": 0, "d": 0, "e": 2, "f": 3, "g": 3, "h": 0}
    # a path is known by the number of its segments alone
    malformed, degenerate = "missing or malformed", "zero-length or degenerate"
    # a path is known by the number of its segments alone
    assert {k: r["reason"] for k, r in found.items() if r["reason"]} == {"i": malformed, "j": malformed, "k": malformed, "m": malformed, "r": malformed, "s": malformed, "l": degenerate, "n": degenerate, "o": "duplicate", "p": "duplicate", "q": "duplicate"}
    assert found["a"]["x2"] == 3.001 and [found[k]["area"] for k in "bfeg"] == [6.0, 6.0, None, None] and found["d"]["area"] == pytest.approx(2 * 3.141592653589793)
    assert [tuple(found[k]["box"]) for k in "adfgh"] == [(0.0, 0.0, 3.001, 4.0), (3.0, 4.0, 7.0, 6.0), (0.0, 0.0, 4.0, 3.0), (0.0, 0.0, 2.0, 2.0), (1.0, 2.0, 1.0, 2.0)]
    assert [k for k in "abcdefgho" if found[k]["closed"]] == list("bcdfg")


def test_svg_documents(spark):
    good = b'<svg viewBox="0,0,10,10" width="5mm"><g id="A"><line x1="1"/><a><rect/></a></g><text>hi</text></svg>'
    files = spark.createDataFrame([(1, good), (2, b"<svg><g></svg>"), (3, b""), (4, None), (5, b"<svg></svg>"), (6, b"<div><p/></div>")], "import_id long, content binary")
    heads = {r["import_id"]: r for r in svg.headers(files).collect()}
    assert [heads[k]["ok"] for k in range(1, 7)] == [True, False, False, False, False, False] and heads[2]["line"] == 1
    found = svg.elements(files).orderBy("ord").collect()
    assert [(r["id"], r["type"], r["layer"], r["text"]) for r in found] == [("el-0", "line", "A", None), ("el-1", "text", None, "hi")]
    box = svg.bounds(svg.headers(files)).first()
    assert (box["max_x"], box["max_y"], box["unit"]) == (5.0, None, "mm")


def edges_of(spark, rows):
    return spark.createDataFrame([("G", *r) for r in rows], "graph_id string, src string, dst string, cost double")


def test_ties_take_the_smaller_predecessor(spark):
    e = edges_of(spark, [("A", "B", 1.0), ("A", "C", 1.0), ("B", "D", 1.0), ("C", "D", 1.0)])
    tree = routing.shortest_tree(e, spark.createDataFrame([("G", "A")], "graph_id string, origin string"))
    found = routing.paths(tree, spark.createDataFrame([("G", "A", "D"), ("G", "A", "X")], "graph_id string, origin string, destination string")).collect()
    assert [(r["path"], r["total_cost"]) for r in found] == [(["A", "B", "D"], 2.0)]


def test_shortest_costs_equal_a_heap_search(spark):
    rng = random.Random(3)
    rows = [(f"n{a}", f"n{b}", rng.choice([0.1, 0.2, 0.3, 1.0])) for a in range(30) for b in rng.sample(range(30), 3) if a != b]
    best, heap = {}, [(0.0, "n0")]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in best:
            best[n] = d
            for a, b, c in rows:
                if a == n and b not in best:
                    heapq.heappush(heap, (d + c, b))
    got = routing.shortest_costs(edges_of(spark, rows), spark.createDataFrame([("G", "n0")], "graph_id string, origin string")).collect()
    assert {r["node_id"]: round(r["cost"], 9) for r in got} == {k: round(v, 9) for k, v in best.items()}


def test_path_audit_finds_faults(spark):
    e = edges_of(spark, [("A", "B", 1.0), ("B", "C", 1.0)])
    nodes = spark.createDataFrame([("G", n) for n in "ABC"], "graph_id string, node_id string")
    found = spark.createDataFrame([("G", "A", "C", 2.0, ["A", "B", "C"]), ("G", "A", "B", 1.0 + 1e-8, ["A", "B"]), ("G", "A", "X", 1.0, ["A", "X"]), ("G", "B", "A", 1.0, ["A", "B"])], "graph_id string, origin string, destination string, total_cost double, path array<string>")
    assert sorted((r["check_name"], r["destination"]) for r in routing.path_audit(found, nodes, e).collect()) == [("cost_sum", "B"), ("endpoints", "A"), ("missing_edge", "X"), ("unknown_node", "X")]


def test_graph_validation(spark):
    nodes = spark.createDataFrame([("G", "A"), ("G", "B"), ("H", "A"), ("H", "B")], "graph_id string, node_id string")
    edges = spark.createDataFrame([("H", 1, "A", "A", 1.0), ("H", 2, "A", "B", 1.0)], "graph_id string, ord long, src string, dst string, cost double")
    found = {r["graph_id"]: r["validation"] for r in graphs.validation_status(nodes, edges, graphs.structure_audit(nodes, edges, "ord")).collect()}
    assert found == {"G": "VALID_WITH_WARNINGS", "H": "INVALID"}


def test_edge_pairs_are_mirrored_once(spark):
    c = spark.createDataFrame([("G", 1, "a", "b"), ("G", 2, "b", "a"), ("G", 3, "a", "a")], "graph_id string, ord long, src string, dst string")
    assert sorted((r["src"], r["dst"]) for r in graphs.generate_edges(c, "ord").collect()) == [("a", "b"), ("b", "a")]


@pytest.mark.parametrize(
    ("category", "around", "wanted"),
    [("DOORWAY", ["CORRIDOR"], "BUILDING_ENTRY"), ("DOORWAY", ["ROOM", "CORRIDOR"], "ROOM_ENTRY"), ("DOORWAY", [], None), ("DOORWAY", [None], "BUILDING_ENTRY"), ("CORRIDOR", ["X"], "DEAD_END"), ("CORRIDOR", ["X", "X"], None), ("CORRIDOR", ["X"] * 3, "CORRIDOR_INTERSECTION"), ("VERTICAL_CONNECTOR", [], "VERTICAL_CONNECTOR"), ("ROOM", ["ROOM"], None)],
)
def test_candidate_rules(spark, category, around, wanted):
    row = spark.createDataFrame([(category, around)], "c string, a array<string>")
    assert row.select(graphs.candidate_type(F.col("c"), F.col("a")).alias("v")).first()["v"] == wanted


def test_lifecycle(spark):
    calls = spark.createDataFrame([(1, k, a) for k, a in enumerate(["PAUSE", "START", "PAUSE", "RESUME", "COMPLETE", "START"])], "session_id long, call_no long, action string")
    assert tuple(sessions.fold(calls, "session_id").first()) == (1, "COMPLETED", 4, 2)


def test_progress_and_events(spark):
    seg = spark.createDataFrame([(7, k, f"n{k - 1}", f"n{k}") for k in range(1, 5)], "route_id long, sequence long, source string, target string")
    routes = spark.createDataFrame([(7, "n0", 8.0)], "route_id long, origin string, total_cost double")
    at = {r["step"]: r for r in sessions.progress(seg, routes).collect()}
    assert (at[2]["remaining_segments"], at[2]["remaining_cost"], at[2]["percentage"], at[2]["completed"]) == (2, 4.0, 50.0, False)
    assert at[0]["current_segment"] is None and at[4]["completed"]
    steps = sessions.walk_steps(spark.createDataFrame([(7, k) for k in range(1, 7)], "session_id long, call_no long"), spark.createDataFrame([(7, 4)], "session_id long, total long"))
    assert [r["step"] for r in steps.orderBy("call_no").collect()] == [0, 1, 2, 3, 4, 4]
    told = sessions.session_events(steps, sessions.progress(seg, routes)).where("call_no = 5").orderBy("place").collect()
    assert [r["event_type"] for r in told] == ["SessionStarted", "SegmentEntered", "SegmentCompleted", "NodeReached", "DestinationReached"]
    assert [r["event_type"] for r in sessions.session_events(steps, sessions.progress(seg, routes), F.lit("CANCELLED")).where("call_no = 1").collect()] == ["SessionCancelled"]


def test_chain_audit(spark):
    seg = spark.createDataFrame([(1, 1, "a", "b"), (1, 3, "c", "d")], "route_id long, sequence long, source string, target string")
    assert sorted(r["check_name"] for r in routing.chain_audit(seg).collect()) == ["broken_chain", "sequence_gap"]


def test_nearest_tie_takes_the_first(spark):
    nodes = spark.createDataFrame([("G", "b", 2, 0.0, 1.0), ("G", "a", 1, 0.0, -1.0), ("G", "c", 0, None, None)], "graph_id string, node_id string, ord long, x double, y double")
    p = spark.createDataFrame([(1, 5, "G", 0.0, 0.0)], "event_id long, session_id long, graph_id string, x double, y double")
    assert positioning.nearest_node(p, nodes).first()["node_id"] == "a"


def test_relation_types_and_semantics(spark):
    o = spark.createDataFrame([(1, "BOUNDARY"), (2, "WALL"), (3, "OPENING"), (4, "PASSAGE")], "uso_id long, spatial_category string")
    c = spark.createDataFrame([(1, 2, 1, "CONTAINS"), (2, 3, 4, "TOUCHES"), (3, 3, 9, "TOUCHES"), (4, 1, 3, "ODD")], "ord long, src long, dst long, candidate_type string")
    assert sorted(tuple(r) for r in objects.resolve_relationships(o, c).collect()) == [(1, 2, "BOUNDED_BY"), (3, 4, "CONNECTS")]
    rules = spark.createDataFrame([("R", "WALL", "STRUCTURAL_WALL", 100, 1)], "rule_id string, spatial_category string, semantic_category string, priority int, rule_ord int")
    models = {r["uso_id"]: r for r in objects.semantic_models(o, objects.resolve_conflicts(objects.match_rules(o, rules))).collect()}
    assert models[1]["confidence_source"] == "UNCLASSIFIED" and models[2]["confidence"] == 1.0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    found = {r["node"]: r["label"] for r in connected_components(links).collect()}
    assert set(found.values()) == {0, 500} and len(found) == 203
    assert connected_components(links.where("false")).count() == 0


def test_unique_inserts(spark):
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    ok, bad = tables.insert_unique(rows, spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, v string"), "k")
    assert [tuple(r) for r in ok.collect()] == [(2, "y")] and bad.count() == 2


def test_rolling_hash_takes_utf16_units(spark):
    texts = ["", "a", "wall-1", "Zürich", "\U0001f600", "x\U0001f6aay" * 5]

    def plain(text):
        raw, h = text.encode("utf-16-le"), 0
        for k in range(0, len(raw), 2):
            h = (h * 31 + int.from_bytes(raw[k : k + 2], "little") + 2**31) % 2**32 - 2**31
        return abs(h)

    found = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", g.rolling_hash(F.col("t")).alias("h")).orderBy("k").collect()
    assert [r["h"] for r in found] == [plain(t) for t in texts]
