"""Queries over SVG documents that are written from the parts' shapes, one per plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwalk.operators import shapes
from planwalk.plans.views import oracle, view
from planwalk.registry import register
from planwalk.sources import svg
from planwalk.sources.scratch import written


def documents(shapes: DataFrame) -> DataFrame:
    """(import_id, content): each plan's shapes as SVG, a group per layer; every seventh document has its viewBox in commas, every fifth is cut short."""
    def a(name: str, column: str):
        return F.concat(F.lit(f' {name}="'), F.col(column).cast("string"), F.lit('"'))

    head = F.concat(F.lit("<"), "type", F.lit(' id="'), "id", F.lit('"'))
    body = F.when(F.col("type") == "line", F.concat(a("x1", "x"), a("y1", "y"), a("x2", "x2"), a("y2", "y2"))).when(F.col("type") == "rect", F.concat(a("x", "x"), a("y", "y"), a("width", "w"), a("height", "h"))).otherwise(F.concat(a("cx", "x"), a("cy", "y"), a("r", "r")))
    tag = F.concat(head, body, F.lit("/>"))
    tagged = shapes.select("import_id", "ord", "layer", tag.alias("tag"))
    # a plan has a few hundred shapes at most
    groups = tagged.groupBy("import_id", "layer").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "tag"))), lambda s: s["tag"]), "").alias("tags"))
    group = F.when(F.col("layer").isNull(), F.col("tags")).otherwise(F.concat(F.lit('<g id="'), "layer", F.lit('">'), "tags", F.lit("</g>")))
    whole = groups.groupBy("import_id").agg(F.array_join(F.array_sort(F.collect_list(group)), "").alias("body"))
    box = F.when(F.col("import_id") % 7 == 1, "0,0,500,300").otherwise("0 0 500 300")
    content = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="12.5mm" height="7.5mm" viewBox="'), box, F.lit('">'), "body", F.when(F.col("import_id") % 5 == 3, "").otherwise("</svg>"))
    return whole.select("import_id", content.alias("content"))


@register(oracle("SELECT import_id, id, type, layer, x FROM f_prims WHERE import_id % 5 <> 3"))
def svg_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements that the parser finds in all documents."""
    found = svg.elements(documents(view(spark, sf_dir, "f_prims")))
    x = F.coalesce(F.col("attributes")["x"], F.col("attributes")["x1"], F.col("attributes")["cx"]).cast("double")
    return found.select("import_id", "id", "type", "layer", x.alias("x"))


@register(oracle("SELECT import_id, layer, count(*) AS n FROM f_prims WHERE import_id % 5 <> 3 AND layer IS NOT NULL GROUP BY import_id, layer"))
def svg_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of all documents."""
    return svg.layers(svg.elements(documents(view(spark, sf_dir, "f_prims"))))


@register(oracle("SELECT import_id, cast(0 AS double) AS min_x, cast(0 AS double) AS min_y, CASE WHEN import_id % 7 = 1 THEN 12.5 ELSE 500 END AS max_x, CASE WHEN import_id % 7 = 1 THEN 7.5 ELSE 300 END AS max_y, 'mm' AS unit FROM f_prims WHERE import_id % 5 <> 3 GROUP BY import_id"))
def svg_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of all valid documents."""
    return svg.bounds(svg.headers(documents(view(spark, sf_dir, "f_prims"))))


@register(oracle("SELECT import_id, import_id % 5 <> 3 AS ok, CASE WHEN import_id % 5 = 3 THEN 0 ELSE count(*) END AS n_elements FROM f_prims GROUP BY import_id"))
def svg_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validity of all documents."""
    return svg.headers(documents(view(spark, sf_dir, "f_prims"))).select("import_id", "ok", "n_elements")


@register(
    oracle(
        """WITH s AS (SELECT import_id, id, 0 AS seg, x AS x1, y AS y1, x2, y2, false AS closed FROM f_prims WHERE type = 'line'
UNION ALL SELECT import_id, id, 0, x, y, x + w, y, true FROM f_prims WHERE type = 'rect' UNION ALL SELECT import_id, id, 1, x + w, y, x + w, y + h, true FROM f_prims WHERE type = 'rect'
UNION ALL SELECT import_id, id, 2, x + w, y + h, x, y + h, true FROM f_prims WHERE type = 'rect' UNION ALL SELECT import_id, id, 3, x, y + h, x, y, true FROM f_prims WHERE type = 'rect')
SELECT import_id, id, cast(seg AS bigint) AS seg, x1, y1, x2, y2, closed FROM s"""
    )
)
def path_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and rects written as paths with absolute and relative commands, read back as segments."""
    c = {k: F.col(k).cast("string") for k in ("x", "y", "x2", "y2", "w", "h")}
    line = F.concat(F.lit("M"), c["x"], F.lit(" "), c["y"], F.lit(" L"), c["x2"], F.lit(","), c["y2"])
    rect = F.concat(F.lit("M "), c["x"], F.lit(" "), c["y"], F.lit(" h"), c["w"], F.lit(" v"), c["h"], F.lit(" H"), c["x"], F.lit(" Z"))
    rows = view(spark, sf_dir, "f_prims").where("type <> 'circle'")
    return svg.paths(rows.select("import_id", "id", F.when(F.col("type") == "line", line).otherwise(rect).alias("d")))


def drawings(found: DataFrame) -> DataFrame:
    """(import_id, content): plans with lines, rects, circles, ellipses, polylines, polygons, paths and texts, a group per layer, in the order of their elements."""
    at = lambda dx, dy: F.concat((F.col("x") + dx).cast("string"), F.lit(" "), (F.col("y") + dy).cast("string"))
    put = lambda text, *columns: F.format_string(text, *(F.col(c).cast("string") if isinstance(c, str) else c for c in columns))
    more = F.array_join(F.array_repeat(F.lit("h.25"), (F.col("k") % 23).cast("int")), "")
    body = (
        F.when(F.col("v") == 0, put('x1="%s" y1="%s" x2="%s" y2="%s"', "x", "y", F.col("x") + 10, "y"))
        .when(F.col("v") == 1, put('x1="%spx" y1="%s" x2="%s" y2="%s"', "x", "y", "x", F.col("y") + 10))
        .when(F.col("v") == 2, put('x="%s" y="%s" width="40" height="4"', "x", "y"))
        .when(F.col("v") == 3, put('cx="%s" cy="%s" r="%s"', "x", "y", F.col("k") % 6))
        .when(F.col("v") == 4, put('cx="%s" cy="%s" rx="3" ry="%s"', "x", "y", F.col("k") % 7))
        .when(F.col("v") == 5, put('points="%s, %s\n%s"', at(0, 0), at(10, 0), at(10, 10)))
        .when(F.col("v") == 6, put('points=" %s,%s,%s "', at(0, 0), at(10, 0), at(10, 10)))
        .when(F.col("v") == 7, put('d="M %sh10 V%s H %sZ"', at(0, 0), F.col("y") + 10, "x"))
        .when(F.col("v") == 8, F.concat(put('d="m%s c 1 1 2-2 10 0 Q%s,%s m 2 3 1.5 -.5', at(0, 0), at(9, 9), at(10, 10)), more, F.lit('"')))
        .when(F.col("v") == 9, put('x="%s" y="%s"', "x", "y"))
        .when(F.col("v") == 10, put('points="%s,%s"', at(0, 0), at(10, 10)))
        .otherwise(put('points="%s %s"', at(0, 0), at(0, 0)))
    )
    tag = F.concat(F.lit('<g id="'), "layer", F.lit('"><'), "type", F.lit(" "), body, F.lit("/></g>"))
    tagged = found.select("import_id", F.struct("ord", tag.alias("tag")).alias("t"))
    whole = tagged.groupBy("import_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["tag"]), "").alias("body"))
    return whole.select("import_id", F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg">'), "body", F.lit("</svg>")).alias("content"))


def drawn_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of all kinds as read from the documents."""
    return svg.drawn(svg.elements(drawings(view(spark, sf_dir, "f_drawn"))))


def cleaned_drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(shapes.clean(drawn_shapes(spark, sf_dir)), "drawn")


@register(
    oracle(
        """SELECT s.import_id, s.id, s.type, s.layer, s.reason, cast(s.n_segments AS bigint) AS n_segments, v IN (2, 3, 4, 6, 7, 10) AS closed,
round(CASE v WHEN 2 THEN 160 WHEN 3 THEN pi() * (k % 6) * (k % 6) WHEN 4 THEN pi() * 3 * (k % 7) WHEN 6 THEN 50 END, 6) AS area,
CASE WHEN v = 3 THEN x - k % 6 WHEN v = 4 THEN x - 3 ELSE x END AS min_x, CASE WHEN v = 3 THEN y - k % 6 WHEN v = 4 THEN y - k % 7 ELSE y END AS min_y,
CASE WHEN v = 3 THEN x + k % 6 WHEN v = 4 THEN x + 3 WHEN v IN (9, 11) THEN x ELSE coalesce(t.max_x, x) END AS max_x, CASE WHEN v = 3 THEN y + k % 6 WHEN v = 4 THEN y + k % 7 WHEN v IN (9, 11) THEN y ELSE coalesce(t.max_y, y) END AS max_y
FROM f_shapes s LEFT JOIN (SELECT ord AS o, max(greatest(x1, x2)) AS max_x, max(greatest(y1, y2)) AS max_y FROM f_strokes GROUP BY ord) t ON t.o = s.ord WHERE v <> 10
UNION ALL SELECT import_id, id, type, layer, reason, cast(1 AS bigint), true, 0, x, y, x + 10, y + 10 FROM f_shapes WHERE v = 10"""
    )
)
def drawn_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments, closedness, area and box of every shape of every kind, and why it is removed."""
    found = shapes.with_reason(drawn_shapes(spark, sf_dir))
    box = [F.col(f"box.{c}").alias(c) for c in shapes.BOX]
    return found.select("import_id", "id", "type", "layer", "reason", F.size("segments").cast("long").alias("n_segments"), "closed", F.round("area", 6).alias("area"), *box)


_DRAWN = """segs AS (SELECT s.* FROM f_strokes s JOIN f_shapes f ON f.ord = s.ord WHERE f.reason IS NULL),
ends AS (SELECT import_id, ord, id, seg, 0 AS e, x1 AS x, y1 AS y FROM segs UNION ALL SELECT import_id, ord, id, seg, 1, x2, y2 FROM segs),
nodes AS (SELECT import_id, x, y, count(DISTINCT id) AS n_shapes, count(*) AS degree, row_number() OVER (PARTITION BY import_id ORDER BY min(ord * 1000 + seg * 10 + e)) AS node_no FROM ends GROUP BY import_id, x, y)"""


@register(oracle(f"WITH {_DRAWN} SELECT import_id, x, y, n_shapes, degree, node_no FROM nodes"))
def drawn_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topology nodes of plans with shapes of all kinds, from the documents on."""
    return shapes.nodes(cleaned_drawings(spark, sf_dir))


@register(oracle(f"WITH {_DRAWN} SELECT s.import_id, s.id, cast(s.seg AS bigint) AS seg, a.node_no AS from_node, b.node_no AS to_node FROM segs s JOIN nodes a ON a.import_id = s.import_id AND a.x = s.x1 AND a.y = s.y1 JOIN nodes b ON b.import_id = s.import_id AND b.x = s.x2 AND b.y = s.y2"))
def drawn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topology edges of plans with shapes of all kinds, from the documents on."""
    return shapes.edges(cleaned_drawings(spark, sf_dir))
