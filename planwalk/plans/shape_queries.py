"""Queries over floor-plan shapes: scalar geometry, cleaning, topology, classification, relationships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwalk.functions import geometry as g
from planwalk.operators import shapes
from planwalk.plans.views import oracle, view
from planwalk.registry import register

_BOX = """CASE type WHEN 'line' THEN least(x, x2) WHEN 'circle' THEN x - r ELSE x END AS x0, CASE type WHEN 'line' THEN least(y, y2) WHEN 'circle' THEN y - r ELSE y END AS y0,
CASE type WHEN 'line' THEN greatest(x, x2) WHEN 'circle' THEN x + r ELSE x + w END AS x1, CASE type WHEN 'line' THEN greatest(y, y2) WHEN 'circle' THEN y + r ELSE y + h END AS y1"""
_SEGS = """segs AS (SELECT import_id, ord, id, 0 AS seg, x AS ax, y AS ay, x2 AS bx, y2 AS bz FROM f_clean WHERE type = 'line'
UNION ALL SELECT import_id, ord, id, 0, x, y, x + w, y FROM f_clean WHERE type = 'rect' UNION ALL SELECT import_id, ord, id, 1, x + w, y, x + w, y + h FROM f_clean WHERE type = 'rect'
UNION ALL SELECT import_id, ord, id, 2, x + w, y + h, x, y + h FROM f_clean WHERE type = 'rect' UNION ALL SELECT import_id, ord, id, 3, x, y + h, x, y FROM f_clean WHERE type = 'rect'),
ends AS (SELECT import_id, ord, id, seg, 0 AS e, ax AS x, ay AS y FROM segs UNION ALL SELECT import_id, ord, id, seg, 1, bx, bz FROM segs),
nodes AS (SELECT import_id, x, y, count(DISTINCT id) AS n_shapes, count(*) AS degree, row_number() OVER (PARTITION BY import_id ORDER BY min(ord * 100 + seg * 10 + e)) AS node_no FROM ends GROUP BY import_id, x, y)"""


def _near(p: str, s: str) -> str:
    """Distance test of point p (prefix of x, y) to segment alias s, in SQL."""
    px, py = f"{p}x", f"{p}z" if p.endswith("b") else f"{p}y"
    dx, dy = f"({s}.bx - {s}.ax)", f"({s}.bz - {s}.ay)"
    q = f"({dx} * {dx} + {dy} * {dy})"
    t = f"CASE WHEN {q} = 0 THEN 0 ELSE greatest(0, least(1, (({px} - {s}.ax) * {dx} + ({py} - {s}.ay) * {dy}) / CASE WHEN {q} = 0 THEN 1 ELSE {q} END)) END"
    return f"sqrt(({px} - ({s}.ax + ({t}) * {dx})) * ({px} - ({s}.ax + ({t}) * {dx})) + ({py} - ({s}.ay + ({t}) * {dy})) * ({py} - ({s}.ay + ({t}) * {dy}))) <= 0.5"


_TOUCH = f"""{_SEGS},
touch AS MATERIALIZED (SELECT DISTINCT a.import_id, a.id AS a, b.id AS b, a.ord AS ao, b.ord AS bo FROM segs a JOIN segs b ON a.import_id = b.import_id AND a.ord < b.ord
  AND least(a.ax, a.bx) - 1 <= greatest(b.ax, b.bx) AND least(b.ax, b.bx) - 1 <= greatest(a.ax, a.bx) AND least(a.ay, a.bz) - 1 <= greatest(b.ay, b.bz) AND least(b.ay, b.bz) - 1 <= greatest(a.ay, a.bz)
  WHERE {_near('a.a', 'b')} OR {_near('a.b', 'b')} OR {_near('b.a', 'a')} OR {_near('b.b', 'a')})"""
_COMPONENTS = f"""{_TOUCH},
und AS (SELECT import_id, ao AS p, bo AS q FROM touch UNION SELECT import_id, bo, ao FROM touch),
reach AS (SELECT import_id, ord, ord AS o FROM f_clean UNION SELECT r.import_id, r.ord, u.q FROM reach r JOIN und u ON u.import_id = r.import_id AND u.p = r.o),
comp AS MATERIALIZED (SELECT import_id, ord, min(o) AS component FROM reach GROUP BY import_id, ord)"""
_CYCLES = """e AS (SELECT s.import_id, s.id, a.node_no AS p, b.node_no AS q FROM segs s JOIN nodes a ON a.import_id = s.import_id AND a.x = s.ax AND a.y = s.ay JOIN nodes b ON b.import_id = s.import_id AND b.x = s.bx AND b.y = s.bz),
nund AS (SELECT import_id, p, q FROM e UNION SELECT import_id, q, p FROM e),
nreach AS (SELECT import_id, node_no, node_no AS o FROM nodes UNION SELECT r.import_id, r.node_no, u.q FROM nreach r JOIN nund u ON u.import_id = r.import_id AND u.p = r.o),
ncomp AS (SELECT import_id, node_no, min(o) AS c FROM nreach GROUP BY import_id, node_no),
cyc AS (SELECT e.import_id, c, string_agg(DISTINCT id, ',' ORDER BY id) AS ids, count(DISTINCT id) AS k, count(*) AS n_edges FROM e JOIN ncomp n ON n.import_id = e.import_id AND n.node_no = e.p GROUP BY e.import_id, c),
cycles AS MATERIALIZED (SELECT cyc.*, (SELECT count(*) FROM ncomp n WHERE n.import_id = cyc.import_id AND n.c = cyc.c) AS n_nodes FROM cyc WHERE k > 1)"""


def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.clean(view(spark, sf_dir, "f_prims"))


@register(oracle(f"SELECT import_id, id, {_BOX} FROM f_prims"))
def geom_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounding box of every shape."""
    box = shapes.box_column().alias("b")
    return view(spark, sf_dir, "f_prims").select("import_id", "id", box).select("import_id", "id", F.col("b.min_x").alias("x0"), F.col("b.min_y").alias("y0"), F.col("b.max_x").alias("x1"), F.col("b.max_y").alias("y1"))


@register(oracle("SELECT import_id, id, round(CASE type WHEN 'rect' THEN w * h WHEN 'circle' THEN pi() * r * r END, 6) AS area FROM f_prims"))
def geom_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of every closed shape."""
    area = g.shape_area(F.col("type"), F.col("w"), F.col("h"), F.col("r"))
    return view(spark, sf_dir, "f_prims").select("import_id", "id", F.round(area, 6).alias("area"))


@register(oracle("SELECT import_id, id, floor((x - 200) / 7 * 1000 + 0.5) / 1000 AS x, floor((y - 120) / 7 * 1000 + 0.5) / 1000 AS y FROM f_prims"))
def geom_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates rounded to three places, halves upward."""
    return view(spark, sf_dir, "f_prims").select("import_id", "id", g.half_up((F.col("x") - 200) / 7).alias("x"), g.half_up((F.col("y") - 120) / 7).alias("y"))


@register(oracle("SELECT import_id, id FROM f_clean"))
def clean_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes that cleaning leaves."""
    return _clean(spark, sf_dir).select("import_id", "id")


@register(
    oracle(
        """SELECT import_id, type, CASE WHEN coalesce(CASE type WHEN 'circle' THEN r = 0 WHEN 'rect' THEN w = 0 OR h = 0 ELSE w = 0 AND h = 0 END, false) THEN 'zero-length or degenerate' ELSE 'duplicate' END AS reason, count(*) AS n
FROM f_prims WHERE id NOT IN (SELECT id FROM f_clean) GROUP BY 1, 2, 3"""
    )
)
def reject_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why shapes are removed, counted."""
    return shapes.with_reason(view(spark, sf_dir, "f_prims")).where("reason IS NOT NULL").groupBy("import_id", "type", "reason").agg(F.count(F.lit(1)).alias("n"))


@register(oracle("SELECT import_id, type, layer_key, count(*) AS n FROM (SELECT import_id, type, coalesce(layer, 'unlayered') AS layer_key FROM f_prims) t GROUP BY GROUPING SETS ((import_id, type), (import_id, layer_key), (import_id))"))
def primitive_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes by type, by layer and in total."""
    return shapes.counts(view(spark, sf_dir, "f_prims"))


@register(oracle(f"WITH {_SEGS} SELECT import_id, x, y, n_shapes, degree, node_no FROM nodes"))
def topology_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct segment ends with their shapes and degree."""
    return shapes.nodes(_clean(spark, sf_dir))


@register(oracle(f"WITH {_SEGS} SELECT s.import_id, s.id, cast(s.seg AS bigint) AS seg, a.node_no AS from_node, b.node_no AS to_node FROM segs s JOIN nodes a ON a.import_id = s.import_id AND a.x = s.ax AND a.y = s.ay JOIN nodes b ON b.import_id = s.import_id AND b.x = s.bx AND b.y = s.bz"))
def topology_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments as edges between numbered nodes."""
    return shapes.edges(_clean(spark, sf_dir))


@register(oracle(f"WITH {_TOUCH} SELECT import_id, a, b FROM touch"))
def touching_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of which an end lies on the other."""
    return shapes.touching_pairs(_clean(spark, sf_dir))


@register(oracle(f"WITH {_COMPONENTS} SELECT import_id, ord, component FROM comp"))
def primitive_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connected shapes."""
    return shapes.shape_components(_clean(spark, sf_dir)).select("import_id", "ord", "component")


@register(
    oracle(
        f"""WITH {_SEGS}, {_CYCLES} SELECT import_id, 'primitive' AS source, id AS ids, round(CASE type WHEN 'rect' THEN w * h ELSE pi() * r * r END, 6) AS area FROM f_clean WHERE type IN ('rect', 'circle')
UNION ALL SELECT import_id, 'component-cycle', ids, NULL FROM cycles WHERE n_edges >= n_nodes"""
    )
)
def closed_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed shapes and cycles of several shapes."""
    return shapes.closed_boundaries(_clean(spark, sf_dir)).select("import_id", "source", F.array_join("ids", ",").alias("ids"), F.round("area", 6).alias("area"))


@register(
    oracle(
        f"""WITH {_SEGS}, {_CYCLES},
part AS (SELECT c.import_id, c.c, c.ids, min(n.node_no) AS s, bool_and(n.degree = 2) AS ring, count(*) AS n_nodes FROM cycles c JOIN ncomp m ON m.import_id = c.import_id AND m.c = c.c
  JOIN nodes n ON n.import_id = m.import_id AND n.node_no = m.node_no WHERE c.n_edges >= c.n_nodes GROUP BY c.import_id, c.c, c.ids),
walk AS (SELECT p.import_id, p.c, p.s, p.s AS a, min(u.q) AS b FROM part p JOIN nund u ON u.import_id = p.import_id AND u.p = p.s WHERE ring AND n_nodes > 2 GROUP BY p.import_id, p.c, p.s
  UNION ALL SELECT w.import_id, w.c, w.s, w.b, u.q FROM walk w JOIN nund u ON u.import_id = w.import_id AND u.p = w.b AND u.q <> w.a WHERE w.b <> w.s),
area AS (SELECT w.import_id, w.c, abs(sum(a.x * b.y - b.x * a.y)) / 2 AS area FROM walk w JOIN nodes a ON a.import_id = w.import_id AND a.node_no = w.a JOIN nodes b ON b.import_id = w.import_id AND b.node_no = w.b GROUP BY w.import_id, w.c)
SELECT p.import_id, p.ids, round(CASE WHEN ring AND n_nodes = 2 THEN 0 ELSE area END, 6) AS area, CASE WHEN NOT ring THEN 'branching' END AS warning FROM part p LEFT JOIN area ON area.import_id = p.import_id AND area.c = p.c"""
    )
)
def enclosures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of several shapes with the areas of their rings, or a warning where a ring branches."""
    return shapes.enclosures(_clean(spark, sf_dir)).select("import_id", F.array_join("ids", ",").alias("ids"), F.round("area", 6).alias("area"), "warning")


@register(
    oracle(
        f"""WITH {_COMPONENTS}, size AS (SELECT import_id, component, count(*) AS n FROM comp GROUP BY import_id, component)
SELECT f.import_id, f.id, CASE WHEN n = 1 THEN 'passage' ELSE 'wall' END AS kind, round(CASE WHEN type = 'rect' THEN greatest(w, h) / greatest(least(w, h), 0.001) END, 6) AS aspect_ratio
FROM f_clean f JOIN comp c ON c.import_id = f.import_id AND c.ord = f.ord JOIN size s ON s.import_id = c.import_id AND s.component = c.component
WHERE type = 'line' OR (type = 'rect' AND greatest(w, h) / greatest(least(w, h), 0.001) >= 4)"""
    )
)
def walls_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wall-shaped shapes: walls if they touch something, else passages."""
    return shapes.walls_and_passages(_clean(spark, sf_dir)).withColumn("aspect_ratio", F.round("aspect_ratio", 6))


@register(
    oracle(
        f"""WITH {_COMPONENTS}, {_CYCLES},
sets AS (SELECT f.import_id, component, string_agg(id, ',' ORDER BY id) AS ids, count(*) AS n FROM f_clean f JOIN comp c ON c.import_id = f.import_id AND c.ord = f.ord GROUP BY f.import_id, component),
loose AS (SELECT DISTINCT c.import_id, c.component, n.x, n.y FROM nodes n JOIN ends e ON e.import_id = n.import_id AND e.x = n.x AND e.y = n.y JOIN comp c ON c.import_id = e.import_id AND c.ord = e.ord WHERE n.degree = 1)
SELECT l.import_id, l.component, round(sqrt((max(x) - min(x)) * (max(x) - min(x)) + (max(y) - min(y)) * (max(y) - min(y))), 6) AS gap_width FROM loose l JOIN sets s ON s.import_id = l.import_id AND s.component = l.component
WHERE s.n > 1 AND NOT EXISTS (SELECT 1 FROM cycles k WHERE k.import_id = s.import_id AND k.ids = s.ids AND k.n_edges >= k.n_nodes) GROUP BY l.import_id, l.component HAVING count(*) = 2"""
    )
)
def openings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components with exactly two loose ends, and how far apart they are."""
    return shapes.openings(_clean(spark, sf_dir)).withColumn("gap_width", F.round("gap_width", 6))


@register(
    oracle(
        f"""WITH {_COMPONENTS}, size AS (SELECT import_id, component, count(*) AS n FROM comp GROUP BY import_id, component),
m AS (SELECT f.import_id, f.id, concat('boundary-', f.id) AS c FROM f_clean f WHERE type IN ('rect', 'circle')
  UNION ALL SELECT f.import_id, f.id, concat('shape-', f.id) FROM f_clean f)
SELECT DISTINCT t.import_id, x.c AS a, y.c AS b FROM touch t JOIN m x ON x.import_id = t.import_id AND x.id = t.a JOIN m y ON y.import_id = t.import_id AND y.id = t.b WHERE x.c <> y.c"""
    )
)
def touches_rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Touching shapes lifted to the candidates they belong to."""
    rows = _clean(spark, sf_dir)
    members = rows.where("type IN ('rect', 'circle')").select("import_id", "id", F.concat(F.lit("boundary-"), "id").alias("candidate_id")).unionByName(rows.select("import_id", "id", F.concat(F.lit("shape-"), "id").alias("candidate_id")))
    return shapes.candidate_touches(shapes.touching_pairs(rows), members)


@register(
    oracle(
        f"""WITH {_TOUCH}, box AS (SELECT import_id, ord, id, {_BOX} FROM f_clean),
rel AS (SELECT a.import_id, a.id AS a, b.id AS b, CASE WHEN a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1 THEN 'CONTAINS' WHEN b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1 THEN 'CONTAINED'
  WHEN a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 THEN 'INTERSECTS' ELSE 'ADJACENT' END AS relation FROM box a JOIN box b ON a.import_id = b.import_id AND a.ord < b.ord
  WHERE sqrt(pow(greatest(a.x0 - b.x1, b.x0 - a.x1, 0), 2) + pow(greatest(a.y0 - b.y1, b.y0 - a.y1, 0), 2)) <= 5)
SELECT rel.* FROM rel WHERE NOT EXISTS (SELECT 1 FROM touch t WHERE t.import_id = rel.import_id AND t.a = rel.a AND t.b = rel.b)"""
    )
)
def bbox_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment, intersection and adjacency of boxes that do not touch."""
    return shapes.box_relationships(_clean(spark, sf_dir))


@register(
    oracle(
        """SELECT import_id, id, CASE WHEN type = 'line' THEN concat('LINESTRING(', cast(x AS varchar), ' ', cast(y AS varchar), ', ', cast(x2 AS varchar), ' ', cast(y2 AS varchar), ')')
  WHEN type = 'circle' THEN concat('POINT(', cast(x AS varchar), ' ', cast(y AS varchar), ')')
  ELSE concat('POLYGON((', cast(x AS varchar), ' ', cast(y AS varchar), ', ', cast(x + w AS varchar), ' ', cast(y AS varchar), ', ', cast(x + w AS varchar), ' ', cast(y + h AS varchar), ', ', cast(x AS varchar), ' ', cast(y + h AS varchar), CASE WHEN h = 0 THEN '' ELSE concat(', ', cast(x AS varchar), ' ', cast(y AS varchar)) END, '))') END AS wkt FROM f_prims"""
    )
)
def shape_wkt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes as well-known text; a ring is closed if it is not."""
    def p(x: str, y: str):
        return F.struct(F.expr(x).alias("x"), F.expr(y).alias("y"))

    line = F.array(p("x", "y"), p("x2", "y2"))
    ring = F.array(p("x", "y"), p("x + w", "y"), p("x + w", "y + h"), p("x", "y + h"))
    wkt = F.when(F.col("type") == "line", g.line_wkt(line)).when(F.col("type") == "circle", g.point_wkt(p("x", "y"))).otherwise(g.polygon_wkt(ring))
    return view(spark, sf_dir, "f_prims").select("import_id", "id", wkt.alias("wkt"))


_CANDIDATES = f"""{_COMPONENTS}, {_CYCLES}, size AS (SELECT import_id, component, count(*) AS n FROM comp GROUP BY import_id, component),
ring AS (SELECT c.import_id, c.c, c.ids, bool_and(n.degree = 2) AS plain FROM cycles c JOIN ncomp m ON m.import_id = c.import_id AND m.c = c.c JOIN nodes n ON n.import_id = m.import_id AND n.node_no = m.node_no
  WHERE c.n_edges >= c.n_nodes GROUP BY c.import_id, c.c, c.ids),
kinds AS (SELECT import_id, 1 AS place, 'BOUNDARY' AS t, id AS ids FROM f_clean WHERE type IN ('rect', 'circle') UNION SELECT import_id, 1, 'BOUNDARY', ids FROM ring
  UNION SELECT import_id, 2, 'ENCLOSURE', id FROM f_clean WHERE type IN ('rect', 'circle') UNION SELECT import_id, 2, 'ENCLOSURE', ids FROM ring WHERE plain
  UNION SELECT f.import_id, CASE WHEN n = 1 THEN 5 ELSE 4 END, CASE WHEN n = 1 THEN 'PASSAGE' ELSE 'WALL' END, f.id FROM f_clean f JOIN comp c ON c.import_id = f.import_id AND c.ord = f.ord
    JOIN size s ON s.import_id = c.import_id AND s.component = c.component WHERE type = 'line' OR (type = 'rect' AND greatest(w, h) / greatest(least(w, h), 0.001) >= 4)),
cand AS MATERIALIZED (SELECT import_id, place, t, ids, concat(lower(t), '-', md5(ids)) AS cid FROM kinds),
member AS MATERIALIZED (SELECT import_id, place, t, cid, unnest(string_split(ids, ',')) AS id FROM cand),
box AS (SELECT import_id, id, {_BOX} FROM f_clean),
cbox AS MATERIALIZED (SELECT m.import_id, place, cid, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, min(c.ids) AS ids FROM member m JOIN box b ON b.import_id = m.import_id AND b.id = m.id
  JOIN (SELECT import_id AS i, cid AS k, ids FROM cand) c ON c.i = m.import_id AND c.k = m.cid GROUP BY m.import_id, place, cid)"""
_GAPS = """sets AS (SELECT f.import_id, component, string_agg(id, ',' ORDER BY id) AS ids, count(*) AS n FROM f_clean f JOIN comp c ON c.import_id = f.import_id AND c.ord = f.ord GROUP BY f.import_id, component),
loose AS (SELECT DISTINCT c.import_id, c.component, n.x, n.y FROM nodes n JOIN ends e ON e.import_id = n.import_id AND e.x = n.x AND e.y = n.y JOIN comp c ON c.import_id = e.import_id AND c.ord = e.ord WHERE n.degree = 1),
gaps AS (SELECT l.import_id, l.component FROM loose l JOIN sets s ON s.import_id = l.import_id AND s.component = l.component
WHERE s.n > 1 AND NOT EXISTS (SELECT 1 FROM ring k WHERE k.import_id = s.import_id AND k.ids = s.ids) GROUP BY l.import_id, l.component HAVING count(*) = 2)"""


@register(
    oracle(
        f"""WITH {_CANDIDATES}, {_GAPS} SELECT c.import_id, c.t AS candidate_type, c.cid AS candidate_id, cast(len(string_split(c.ids, ',')) AS bigint) AS n_members, x0 AS min_x, y0 AS min_y, x1 AS max_x, y1 AS max_y
FROM cand c JOIN cbox b ON b.import_id = c.import_id AND b.cid = c.cid UNION ALL SELECT import_id, 'OPENING', concat('opening-', cast(component AS varchar)), 0, NULL, NULL, NULL, NULL FROM gaps"""
    )
)
def geometry_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates that classification finds, as sets of shapes with the boxes around them."""
    found = shapes.candidates(shapes.Topology(_clean(spark, sf_dir)))
    return found.select("import_id", "candidate_type", "candidate_id", F.size("ids").cast("long").alias("n_members"), *shapes.BOX)


@register(
    oracle(
        f"""WITH {_CANDIDATES},
met AS MATERIALIZED (SELECT DISTINCT t.import_id, x.cid AS a, y.cid AS b FROM touch t JOIN member x ON x.import_id = t.import_id AND x.id = t.a JOIN member y ON y.import_id = t.import_id AND y.id = t.b WHERE x.cid <> y.cid),
rel AS (SELECT a.import_id, a.cid AS a, b.cid AS b, CASE WHEN a.x0 <= b.x0 AND a.y0 <= b.y0 AND a.x1 >= b.x1 AND a.y1 >= b.y1 THEN 'CONTAINS' WHEN b.x0 <= a.x0 AND b.y0 <= a.y0 AND b.x1 >= a.x1 AND b.y1 >= a.y1 THEN 'CONTAINED'
  WHEN a.x0 <= b.x1 AND b.x0 <= a.x1 AND a.y0 <= b.y1 AND b.y0 <= a.y1 THEN 'INTERSECTS' ELSE 'ADJACENT' END AS r FROM cbox a JOIN cbox b ON a.import_id = b.import_id AND (a.place < b.place OR (a.place = b.place AND a.cid < b.cid)) AND a.ids <> b.ids
  WHERE sqrt(pow(greatest(a.x0 - b.x1, b.x0 - a.x1, 0), 2) + pow(greatest(a.y0 - b.y1, b.y0 - a.y1, 0), 2)) <= 5),
new AS (SELECT rel.* FROM rel LEFT JOIN met m ON m.import_id = rel.import_id AND m.a = rel.a AND m.b = rel.b LEFT JOIN met n ON n.import_id = rel.import_id AND n.a = rel.b AND n.b = rel.a WHERE m.a IS NULL AND n.a IS NULL),
whole AS (SELECT import_id, 'TOUCHES' AS type, a AS from_id, b AS to_id FROM met UNION ALL SELECT import_id, CASE r WHEN 'CONTAINED' THEN 'CONTAINS' ELSE r END, CASE r WHEN 'CONTAINED' THEN b ELSE a END, CASE r WHEN 'CONTAINED' THEN a ELSE b END FROM new)
SELECT import_id, type, from_id, to_id, upper(string_split(from_id, '-')[1]) AS from_type, upper(string_split(to_id, '-')[1]) AS to_type FROM whole"""
    )
)
def candidate_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOUCHES, then CONTAINS, INTERSECTS and ADJACENT of the candidates that classification finds."""
    topology = shapes.Topology(_clean(spark, sf_dir))
    return shapes.candidate_relationships(topology, shapes.candidates(topology))


@register(
    oracle(
        f"""WITH {_CANDIDATES}, {_GAPS},
per AS (SELECT import_id, 'n_nodes' AS k, count(*) AS n FROM nodes GROUP BY import_id UNION ALL SELECT import_id, 'n_edges', count(*) FROM segs GROUP BY import_id UNION ALL SELECT import_id, 'n_touching', count(*) FROM touch GROUP BY import_id
  UNION ALL SELECT import_id, 'n_components', count(DISTINCT component) FROM comp GROUP BY import_id UNION ALL SELECT import_id, 'n_closed', count(*) FROM f_clean WHERE type IN ('rect', 'circle') GROUP BY import_id
  UNION ALL SELECT import_id, 'n_closed', count(*) FROM ring GROUP BY import_id UNION ALL SELECT import_id, concat('n_', lower(t)), count(*) FROM cand GROUP BY import_id, t UNION ALL SELECT import_id, 'n_opening', count(*) FROM gaps GROUP BY import_id
  UNION ALL SELECT import_id, 'n_cleaned', count(*) FROM f_clean GROUP BY import_id UNION ALL SELECT import_id, 'n_shapes', count(*) FROM f_prims GROUP BY import_id
  UNION ALL SELECT import_id, 'n_invalid', count_if(coalesce(CASE type WHEN 'circle' THEN r = 0 WHEN 'rect' THEN w = 0 OR h = 0 ELSE w = 0 AND h = 0 END, false)) FROM f_prims GROUP BY import_id),
t AS (SELECT import_id, {", ".join(f"cast(coalesce(sum(CASE WHEN k = '{k}' THEN n END), 0) AS bigint) AS {k}" for k in ("n_shapes", "n_invalid", "n_cleaned", "n_nodes", "n_edges", "n_touching", "n_components", "n_closed", "n_boundary", "n_enclosure", "n_opening", "n_wall", "n_passage"))} FROM per GROUP BY import_id)
SELECT *, n_shapes - n_invalid - n_cleaned AS n_duplicates FROM t"""
    )
)
def plan_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every stage from the shapes to the candidates, one row per plan."""
    given = view(spark, sf_dir, "f_prims")
    topology = shapes.Topology(shapes.clean(given))
    return shapes.model_counts(given, topology, shapes.candidates(topology))
