"""Cleaning, topology, classification and spatial relationships of floor-plan shapes; many plans (import_id) at once.

Shapes: import_id, ord, id, type, layer, x, y, w, h, r, x2, y2.  Joins between shapes or boxes
go through a grid, so a shape meets only those that share one of its cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwalk.functions import geometry as g
from planwalk.operators.components import connected_components
from planwalk.sources.scratch import written

KEY = ["import_id", "id"]
#: Kinds that may be a wall whatever their proportions.
OPEN_KINDS = ("line", "polyline", "path")


def box_column() -> Column:
    return g.box_of_shape(F.col("type"), *(F.col(c) for c in ("x", "y", "w", "h", "r", "x2", "y2")))


def _box(shapes: DataFrame) -> Column:
    """The box that a shape brings along, as shapes of all kinds do, or else that of a simple one."""
    return F.col("box") if "box" in shapes.columns else box_column()


def segments_column() -> Column:
    """Straight segments of a line or rect; round shapes and texts have none."""
    def s(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        return F.struct(*(g.half_up(v).alias(n) for v, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))))

    x, y, w, h = (F.col(c) for c in "xywh")
    rect = F.array(s(x, y, x + w, y), s(x + w, y, x + w, y + h), s(x + w, y + h, x, y + h), s(x, y + h, x, y))
    line = F.array(s(x, y, F.col("x2"), F.col("y2")))
    return F.when(F.col("type") == "line", line).when(F.col("type") == "rect", rect).otherwise(F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>"))


def degenerate() -> Column:
    """A circle without radius, a rect without an extent, or a line whose ends are one point."""
    x, y, w, h, r, x2, y2, kind = (F.col(c) for c in ("x", "y", "w", "h", "r", "x2", "y2", "type"))
    flat = F.when(kind == "circle", r == 0).when(kind == "rect", (w == 0) | (h == 0)).when(kind == "text", False).otherwise((x == x2) & (y == y2))
    return F.coalesce(flat, F.lit(False))


def invalid() -> Column:
    """Attributes that a kind needs are missing or negative."""
    need = F.when(F.col("type") == "circle", F.col("r") >= 0).when(F.col("type") == "rect", (F.col("w") >= 0) & (F.col("h") >= 0)).otherwise(g.is_finite(F.col("x2")) & g.is_finite(F.col("y2")))
    return ~F.coalesce(g.is_finite(F.col("x")) & g.is_finite(F.col("y")) & need, F.lit(False))


def with_reason(shapes: DataFrame) -> DataFrame:
    """Adds reason: why a shape is removed, null if it stays; of shapes with one geometry in one layer the first by ord stays."""
    geometry = ["key"] if "key" in shapes.columns else ["x", "y", "w", "h", "r"]
    same = Window.partitionBy("import_id", "type", F.coalesce("layer", F.lit("")), *geometry, "bad").orderBy("ord")
    bad = F.when(invalid(), "missing or malformed").when(degenerate(), "zero-length or degenerate")
    rows = shapes if "bad" in shapes.columns else shapes.withColumn("bad", bad)
    rows = rows.withColumn("rn", F.row_number().over(same))
    return rows.withColumn("reason", F.coalesce("bad", F.when(F.col("rn") > 1, "duplicate"))).drop("bad", "rn")


def clean(shapes: DataFrame) -> DataFrame:
    return with_reason(shapes).where("reason IS NULL").drop("reason")


def removal_warnings(shapes: DataFrame) -> DataFrame:
    """(import_id, ord, place, warning): a text for each shape that cleaning removes; a plan's invalid ones come before its duplicates, each in order."""
    gone = with_reason(shapes).where("reason IS NOT NULL")
    text = F.format_string("%s '%s' removed: %s", "type", "id", "reason")
    place = F.row_number().over(Window.partitionBy("import_id").orderBy(F.col("reason") == "duplicate", "ord"))
    return gone.select("import_id", "ord", (place - 1).cast("long").alias("place"), text.alias("warning"))


def counts(shapes: DataFrame) -> DataFrame:
    """Counts by type, by layer and in total, in one pass."""
    keyed = shapes.select("import_id", "type", F.coalesce("layer", F.lit("unlayered")).alias("layer_key"))
    return keyed.groupingSets([["import_id", "type"], ["import_id", "layer_key"], ["import_id"]], "import_id", "type", "layer_key").agg(F.count(F.lit(1)).alias("n"))


def _ends(shapes: DataFrame) -> DataFrame:
    """(import_id, ord, id, seg, x1, y1, x2, y2)."""
    return shapes.select("import_id", "ord", "id", F.posexplode(F.col("segments") if "segments" in shapes.columns else segments_column()).alias("seg", "s")).select("import_id", "ord", "id", "seg", "s.*")


def nodes(shapes: DataFrame) -> DataFrame:
    """(import_id, x, y, n_shapes, degree, node_no): distinct segment ends numbered by first appearance."""
    e = _ends(shapes)
    ends = e.select("import_id", "ord", "id", "seg", F.lit(0).alias("end"), F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(e.select("import_id", "ord", "id", "seg", F.lit(1).alias("end"), F.col("x2").alias("x"), F.col("y2").alias("y")))
    grouped = ends.groupBy("import_id", "x", "y").agg(F.countDistinct("id").alias("n_shapes"), F.count(F.lit(1)).alias("degree"), F.min(F.struct("ord", "seg", "end")).alias("at"))
    number = F.row_number().over(Window.partitionBy("import_id").orderBy("at"))
    return grouped.select("import_id", "x", "y", "n_shapes", "degree", number.cast("long").alias("node_no"))


def edges(shapes: DataFrame) -> DataFrame:
    """(import_id, id, seg, from_node, to_node): one edge per segment."""
    n = nodes(shapes).select("import_id", "x", "y", "node_no")
    e = _ends(shapes)
    for end, name in (("1", "from_node"), ("2", "to_node")):
        e = e.join(n.select("import_id", F.col("x").alias(f"x{end}"), F.col("y").alias(f"y{end}"), F.col("node_no").alias(name)), ["import_id", f"x{end}", f"y{end}"])
    return e.select("import_id", "id", F.col("seg").cast("long").alias("seg"), "from_node", "to_node")


BOX = ["min_x", "min_y", "max_x", "max_y"]


def grid_join(rows: DataFrame, columns: list[str], reach: float, cell: float) -> DataFrame:
    """Pairs of one plan (columns with the suffixes _a and _b, ord_a < ord_b) whose boxes, grown by reach / 2 each, overlap.

    rows: import_id, ord, BOX and `columns`.  Cells double in width from level to level; a
    box belongs to the first level at which it spans two cells a side at most, and two boxes
    meet at the level of the larger one, so a large box covers few cells as well.  A pair is
    kept only in the cell of the greater lower corner, which both cover.
    """
    half = reach / 2
    low, high = ({c: F.col(f"{name}_{c}") + sign * half for c in "xy"} for name, sign in (("min", -1), ("max", 1)))
    size = F.greatest(*(high[c] - low[c] for c in "xy"))
    own = F.greatest(F.lit(0), F.ceil(F.log2(size / cell))).cast("int")
    rows = rows.where(F.coalesce(*(F.col(c) for c in BOX)).isNotNull()).withColumn("own", F.coalesce(own, F.lit(0)))
    rows = written(rows, "boxes")  # read for the levels and for both sides
    levels = sorted(r[0] for r in rows.select("own").distinct().collect())  # a few dozen at most: powers of two
    width = F.pow(F.lit(2.0), F.col("level")) * cell
    dealt = rows.withColumn("level", F.explode(F.array(*map(F.lit, levels)) if levels else F.array(F.lit(0)))).where("level >= own")
    for c in "xy":
        dealt = dealt.withColumn(f"c{c}", F.explode(F.sequence(F.floor(low[c] / width), F.floor(high[c] / width))))
    key = ["import_id", "level", "cx", "cy"]
    a, b = (dealt.select(*key, *(F.col(c).alias(f"{c}_{x}") for c in dict.fromkeys(["ord", "own", *BOX, *columns]))) for x in "ab")
    pairs = a.join(b, key).where((F.col("ord_a") < F.col("ord_b")) & (F.greatest("own_a", "own_b") == F.col("level")))
    for c in "xy":
        corner = F.floor((F.greatest(f"min_{c}_a", f"min_{c}_b") - half) / width)
        pairs = pairs.where((F.col(f"c{c}") == corner) & (F.col(f"min_{c}_a") - reach <= F.col(f"max_{c}_b")) & (F.col(f"min_{c}_b") - reach <= F.col(f"max_{c}_a")))
    return pairs


def touching_pairs(shapes: DataFrame, cell: float = 20.0) -> DataFrame:
    """(import_id, a, b) of shapes of which an end lies within the tolerance of the other's segments."""
    ends = {"min": F.least, "max": F.greatest}
    rows = _ends(shapes).select("import_id", "ord", "id", "x1", "y1", "x2", "y2", *(f(f"{c}1", f"{c}2").alias(f"{name}_{c}") for name, f in ends.items() for c in "xy"))
    pairs = grid_join(rows, ["id", "x1", "y1", "x2", "y2"], 2 * g.TOUCH_TOLERANCE, cell)
    a, b = (F.struct(*(F.col(f"{c}_{x}").alias(c) for c in ("x1", "y1", "x2", "y2"))) for x in "ab")
    return pairs.where(g.segments_touch(a, b)).select("import_id", F.col("id_a").alias("a"), F.col("id_b").alias("b")).distinct()


def _key(column: str) -> Column:
    return F.concat_ws("/", F.col("import_id").cast("string"), column)


def shape_components(shapes: DataFrame, touching: DataFrame | None = None) -> DataFrame:
    """(import_id, id, ord, component): component is the smallest ord that touching or a shared node leads to; touching may be given."""
    # shapes that share a node touch, so touching pairs are all the links there are
    touching = touching_pairs(shapes) if touching is None else touching
    labels = connected_components(touching.select(_key("a").alias("a"), _key("b").alias("b")))
    rows = shapes.withColumn("node", _key("id")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = rows.groupBy("label").agg(F.min("ord").alias("component"))
    return rows.join(first, "label").select("import_id", "id", "ord", "component")


def cycles(shapes: DataFrame) -> DataFrame:
    """(import_id, component, ids, n_nodes, n_edges): connected parts of the node graph of several shapes with as many edges as nodes or more."""
    e = edges(shapes)
    key = lambda c: F.concat_ws("/", F.col("import_id").cast("string"), F.col(c).cast("string"))
    labels = connected_components(e.select(key("from_node").alias("a"), key("to_node").alias("b")))
    marked = e.withColumn("node", key("from_node")).join(labels, "node", "left").withColumn("component", F.coalesce("label", "node"))
    parts = marked.groupBy("import_id", "component").agg(F.array_sort(F.collect_set("id")).alias("ids"), F.count(F.lit(1)).alias("n_edges"))
    ends = marked.select("component", F.explode(F.array("from_node", "to_node")).alias("n")).groupBy("component").agg(F.countDistinct("n").alias("n_nodes"))
    return parts.join(ends, "component").where((F.size("ids") > 1) & (F.col("n_edges") >= F.col("n_nodes"))).select("import_id", "component", "ids", "n_nodes", "n_edges")


def closed_boundaries(shapes: DataFrame, rings: DataFrame | None = None) -> DataFrame:
    """(import_id, source, ids, area): closed shapes, and cycles that several shapes form; the cycles may be given."""
    closed = shapes.where(F.col("closed") if "closed" in shapes.columns else F.col("type").isin("rect", "circle", "ellipse", "polygon"))
    area = F.col("area") if "area" in shapes.columns else g.shape_area(F.col("type"), F.col("w"), F.col("h"), F.col("r"))
    own = closed.select("import_id", F.lit("primitive").alias("source"), F.array("id").alias("ids"), area.alias("area"))
    return own.unionByName((cycles(shapes) if rings is None else rings).select("import_id", F.lit("component-cycle").alias("source"), "ids", F.lit(None).cast("double").alias("area")))


def enclosures(shapes: DataFrame, rings: DataFrame | None = None) -> DataFrame:
    """(import_id, ids, area, warning): the cycles that several shapes form, with the area of the traced ring; where the ring branches there is no area but a warning."""
    key = lambda c: F.concat_ws("/", F.col("import_id").cast("string"), F.col(c).cast("string"))
    found = written(cycles(shapes), "cycles") if rings is None else rings
    links = edges(shapes).select("import_id", "id", key("from_node").alias("a"), key("to_node").alias("b"))
    of_shape = found.select("import_id", "component", F.explode("ids").alias("id"))
    links = links.join(of_shape, ["import_id", "id"])
    at = nodes(shapes).select(key("node_no").alias("node"), "x", "y")
    points = links.select("component", F.explode(F.array("a", "b")).alias("node")).distinct().join(at, "node")
    area = trace_ring(points, links.select("component", "a", "b"))
    rows = found.join(area, "component", "left")
    return rows.select("import_id", "ids", "area", F.when(F.col("area").isNull(), "branching").alias("warning"))


def walls_and_passages(shapes: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """(import_id, id, kind, aspect_ratio): open shapes, and rects of at least the wall's proportions; those that touch nothing are passages."""
    components = shape_components(shapes) if components is None else components
    size = components.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("import_id", "component"))).select("import_id", "id", "n")
    ratio = F.greatest("w", "h") / F.greatest(F.least("w", "h"), F.lit(g.LEAST_DIMENSION))
    rows = shapes.withColumn("aspect_ratio", F.when(F.col("type") == "rect", ratio)).where(F.col("type").isin(*OPEN_KINDS) | (F.col("aspect_ratio") >= g.WALL_ASPECT_RATIO))
    return rows.join(size, KEY).select("import_id", "id", F.when(F.col("n") == 1, "passage").otherwise("wall").alias("kind"), "aspect_ratio")


def openings(shapes: DataFrame, components: DataFrame | None = None, rings: DataFrame | None = None) -> DataFrame:
    """(import_id, component, gap_width): components of several shapes, none of them a closed cycle, with exactly two loose ends."""
    comp = shape_components(shapes) if components is None else components
    sets = comp.groupBy("import_id", "component").agg(F.array_sort(F.collect_set("id")).alias("ids")).where(F.size("ids") > 1)
    open_sets = sets.join((cycles(shapes) if rings is None else rings).select("import_id", "ids"), ["import_id", "ids"], "left_anti")
    e = _ends(shapes)
    at = e.select(*KEY, F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(e.select(*KEY, F.col("x2").alias("x"), F.col("y2").alias("y")))
    loose = nodes(shapes).where("degree = 1").join(at, ["import_id", "x", "y"]).join(comp.select(*KEY, "component"), KEY)
    two = loose.groupBy("import_id", "component").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("p")).where(F.size("p") == 2)
    gap = g.distance(F.get("p", F.lit(0))["x"], F.get("p", F.lit(0))["y"], F.get("p", F.lit(1))["x"], F.get("p", F.lit(1))["y"])
    return two.join(open_sets, ["import_id", "component"]).select("import_id", "component", gap.alias("gap_width"))


def box_relation(a: Column, b: Column) -> Column:
    """First of CONTAINS (either way), INTERSECTS and ADJACENT that holds for two boxes; null if none does."""
    return (
        F.when(g.box_contains(a, b), "CONTAINS").when(g.box_contains(b, a), "CONTAINED").when(g.box_overlap(a, b), "INTERSECTS").when(g.box_gap(a, b) <= g.ADJACENT_GAP, "ADJACENT")
    )


def box_relationships(shapes: DataFrame, cell: float = 40.0) -> DataFrame:
    """(import_id, a, b, relation) of shapes that do not touch."""
    rows = shapes.select("import_id", "ord", "id", _box(shapes).alias("box")).select("import_id", "ord", "id", *(F.col(f"box.{c}").alias(c) for c in BOX))
    pairs = grid_join(rows, ["id"], g.ADJACENT_GAP, cell)
    a, b = (F.struct(*(F.col(f"{c}_{x}").alias(c) for c in BOX)) for x in "ab")
    pairs = pairs.select("import_id", F.col("id_a").alias("a"), F.col("id_b").alias("b"), box_relation(a, b).alias("relation"))
    return pairs.where("relation IS NOT NULL").join(touching_pairs(shapes), ["import_id", "a", "b"], "left_anti")


#: The kinds of candidates in the order in which they are listed.
CANDIDATES = {"BOUNDARY": 1, "ENCLOSURE": 2, "OPENING": 3, "WALL": 4, "PASSAGE": 5}


class Topology:
    """What cleaned shapes form together, each table computed once and kept in the shared folder: touching pairs, components, cycles."""

    def __init__(self, shapes: DataFrame):
        self.shapes = written(shapes, "cleaned")
        self.touching = written(touching_pairs(self.shapes), "touching")
        self.components = written(shape_components(self.shapes, self.touching), "components")
        self.rings = written(cycles(self.shapes), "cycles")


def candidates(topology: Topology) -> DataFrame:
    """(import_id, candidate_id, candidate_type, place, ids, digest, BOX, size): what classification finds, as sets of shapes.

    Closed shapes and cycles are boundaries; those whose area is known are enclosures too; then
    openings, walls and passages.  A candidate is known by its type and a digest of its sorted
    members, so one set is one candidate of a type; an opening, which has no members and no
    box, is known by its component.  place orders a plan's candidates by type.  size is the
    area, the gap, or the aspect ratio.
    """
    t = topology

    def kind(rows: DataFrame, name: str | Column, ids: Column, size: Column) -> DataFrame:
        return rows.select("import_id", (F.lit(name) if isinstance(name, str) else name).alias("candidate_type"), ids.alias("ids"), size.alias("size"))

    closed = closed_boundaries(t.shapes, t.rings)
    areas = enclosures(t.shapes, t.rings).where("warning IS NULL")
    own = F.array_sort("ids")
    found = kind(closed, "BOUNDARY", own, F.lit(None).cast("double"))
    found = found.unionByName(kind(closed.where("source = 'primitive' AND area IS NOT NULL"), "ENCLOSURE", own, F.col("area")))
    found = found.unionByName(kind(areas, "ENCLOSURE", own, F.col("area")))
    found = found.unionByName(kind(walls_and_passages(t.shapes, t.components), F.upper("kind"), F.array("id"), F.col("aspect_ratio")))
    found = found.withColumn("digest", F.md5(F.concat_ws(",", "ids")))
    gaps = openings(t.shapes, t.components, t.rings)
    gaps = gaps.select("import_id", F.lit("OPENING").alias("candidate_type"), F.array().cast("array<string>").alias("ids"), F.col("gap_width").alias("size"), F.col("component").cast("string").alias("digest"))
    found = found.unionByName(gaps).groupBy("import_id", "candidate_type", "digest").agg(F.first("ids").alias("ids"), F.max("size").alias("size"))
    found = written(found.withColumn("candidate_id", F.concat_ws("-", F.lower("candidate_type"), "digest")), "candidates")
    boxes = t.shapes.select("import_id", "id", _box(t.shapes).alias("box"))
    members = found.select("import_id", "candidate_id", F.explode("ids").alias("id")).join(boxes, KEY)
    ends = {"min_x": F.min, "min_y": F.min, "max_x": F.max, "max_y": F.max}
    around = members.groupBy("import_id", "candidate_id").agg(*(f(f"box.{c}").alias(c) for c, f in ends.items()))
    place = F.element_at(F.create_map(*(F.lit(x) for kv in CANDIDATES.items() for x in kv)), F.col("candidate_type"))
    return written(found.withColumn("place", place).join(around, ["import_id", "candidate_id"], "left"), "candidate-boxes")


def candidate_relationships(topology: Topology, found: DataFrame, cell: float = 40.0) -> DataFrame:
    """(import_id, type, from_id, to_id, from_type, to_type): TOUCHES of candidates whose shapes touch, then for other pairs how their boxes lie.

    Pairs of candidates that touch in either order, or consist of the same shapes, have no box
    relation.  CONTAINS leads from the outer one; INTERSECTS and ADJACENT lead from the one
    that is listed first.
    """
    members = found.select("import_id", "candidate_id", F.explode("ids").alias("id"))
    touch = written(candidate_touches(topology.touching, members), "candidate-touches")
    rows = found.where("min_x IS NOT NULL").withColumn("ord", F.struct("place", "candidate_id"))
    pairs = grid_join(rows.select("import_id", "ord", "candidate_id", "digest", *BOX), ["candidate_id", "digest"], g.ADJACENT_GAP, cell).where("digest_a <> digest_b")
    a, b = (F.struct(*(F.col(f"{c}_{x}").alias(c) for c in BOX)) for x in "ab")
    pairs = pairs.select("import_id", F.col("candidate_id_a").alias("a"), F.col("candidate_id_b").alias("b"), box_relation(a, b).alias("relation")).where("relation IS NOT NULL")
    met = touch.select("import_id", F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).distinct()
    pairs = pairs.withColumns({"x": F.least("a", "b"), "y": F.greatest("a", "b")}).join(met, ["import_id", "x", "y"], "left_anti")
    turned = F.col("relation") == "CONTAINED"
    boxed = pairs.select("import_id", F.when(turned, "CONTAINS").otherwise(F.col("relation")).alias("type"), F.when(turned, F.col("b")).otherwise(F.col("a")).alias("from_id"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("to_id"))
    out = touch.select("import_id", F.lit("TOUCHES").alias("type"), F.col("a").alias("from_id"), F.col("b").alias("to_id")).unionByName(boxed)
    kind = lambda c: F.upper(F.substring_index(c, "-", 1))
    return out.withColumns({"from_type": kind("from_id"), "to_type": kind("to_id")})


def model_counts(shapes: DataFrame, topology: Topology, found: DataFrame) -> DataFrame:
    """One row per plan: shapes given, removed and left, nodes, edges, touching pairs, components, closed boundaries, and candidates of each type."""
    per = lambda rows, name: rows.groupBy("import_id").agg(F.count(F.lit(1)).alias(name))
    judged = with_reason(shapes).groupBy("import_id").agg(F.count(F.lit(1)).alias("n_shapes"), F.count_if(F.col("reason") == "duplicate").alias("n_duplicates"), F.count_if((F.col("reason") != "duplicate") & F.col("reason").isNotNull()).alias("n_invalid"))
    out = judged.withColumn("n_cleaned", F.col("n_shapes") - F.col("n_duplicates") - F.col("n_invalid"))
    t = topology
    tables = {"n_nodes": nodes(t.shapes), "n_edges": _ends(t.shapes), "n_touching": t.touching, "n_components": t.components.select("import_id", "component").distinct(), "n_closed": closed_boundaries(t.shapes, t.rings)}
    for name, rows in tables.items():
        out = out.join(per(rows, name), "import_id", "left")
    of_type = found.groupBy("import_id").agg(*(F.count_if(F.col("candidate_type") == c).alias(f"n_{c.lower()}") for c in CANDIDATES))
    return out.join(of_type, "import_id", "left").na.fill(0)


def geometry_models(shapes: DataFrame, topology: Topology, found: DataFrame) -> DataFrame:
    """One row per plan: import_id, shapes, warnings, nodes, edges, candidates and box, each list in its order.

    A row is as large as its document, which is bounded, as nodes, edges and candidates are
    linear in a plan's shapes.  Relationships are not: pairs may be as many as the square, so
    they stay a table of their own (candidate_relationships).  Plans of which nothing is left
    have empty lists and no box.
    """
    t = topology

    def listed(rows: DataFrame, order: list[str], columns: list[str], name: str) -> DataFrame:
        item = F.struct(F.struct(*order).alias("at"), F.struct(*columns).alias("v"))
        return rows.groupBy("import_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias(name))

    lines = edges(t.shapes).join(t.shapes.select("import_id", "id", "ord"), KEY)
    lists = [
        listed(t.shapes, ["ord"], ["id", "type", "layer"], "shapes"),
        listed(removal_warnings(shapes), ["place"], ["warning"], "warnings").withColumn("warnings", F.col("warnings.warning")),
        listed(nodes(t.shapes), ["node_no"], ["node_no", "x", "y", "degree"], "nodes"),
        listed(lines, ["ord", "seg"], ["id", "seg", "from_node", "to_node"], "edges"),
        listed(found, ["place", "candidate_id"], ["candidate_type", "candidate_id", "ids"], "candidates"),
    ]
    out = shapes.select("import_id").distinct()
    for rows in lists:
        name = rows.columns[1]
        out = out.join(rows, "import_id", "left").withColumn(name, F.coalesce(name, F.array().cast(rows.schema[name].dataType)))
    around = extent(t.shapes).select("import_id", F.struct(*BOX).alias("box"))
    return out.join(around, "import_id", "left")


def candidate_touches(touching: DataFrame, members: DataFrame) -> DataFrame:
    """(import_id, a, b): touching shapes lifted to the candidates (candidate_id, id) that they belong to; no candidate touches itself."""
    out = touching
    for end in "ab":
        out = out.join(members.select("import_id", F.col("id").alias(end), F.col("candidate_id").alias(f"c{end}")), ["import_id", end])
    return out.where("ca <> cb").select("import_id", F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()


def trace_ring(points: DataFrame, links: DataFrame, by: str = "component") -> DataFrame:
    """(by, area): area of parts of the node graph in which every node has two neighbours; others have no row.

    points: by, node, x, y; links: by, a, b.  A part is one traced ring, held by one task.
    """
    import pandas as pd

    none = pd.DataFrame({by: pd.Series([], dtype=object), "area": pd.Series([], dtype=float)})
    both = links.select(by, F.col("a").alias("node"), F.col("b").alias("next")).unionByName(links.select(by, F.col("b").alias("node"), F.col("a").alias("next")))
    around = both.groupBy(by, "node").agg(F.collect_list("next").alias("around")).join(points, [by, "node"])

    def task(part: pd.DataFrame) -> pd.DataFrame:
        around_of = dict(zip(part["node"], part["around"], strict=True))
        at = {n: (x, y) for n, x, y in zip(part["node"], part["x"], part["y"], strict=True)}
        if any(len(v) != 2 for v in around_of.values()):
            return none
        ring, last, here = [], None, min(at)
        while len(ring) < len(at):
            ring.append(at[here])
            a, b = around_of[here]
            last, here = here, (b if a == last else a)
        if here != min(at) or len(set(ring)) != len(at):
            return none
        area = sum(ring[i][0] * ring[(i + 1) % len(ring)][1] - ring[(i + 1) % len(ring)][0] * ring[i][1] for i in range(len(ring)))
        return pd.DataFrame({by: pd.Series([part[by].iloc[0]], dtype=object), "area": [abs(area) / 2]})

    return around.groupBy(by).applyInPandas(task, f"{by} {dict(points.dtypes)[by]}, area double")


def extent(shapes: DataFrame) -> DataFrame:
    """(import_id, n_shapes, BOX): number of shapes of each plan and the box around all of theirs; null corners where no shape has a box."""
    rows = shapes.select("import_id", _box(shapes).alias("box"))
    ends = {"min_x": F.min, "min_y": F.min, "max_x": F.max, "max_y": F.max}
    return rows.groupBy("import_id").agg(F.count(F.lit(1)).alias("n_shapes"), *(f(f"box.{c}").alias(c) for c, f in ends.items()))
