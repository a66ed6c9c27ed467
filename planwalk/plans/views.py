"""Stage inputs derived from the given tables, in SQL that Spark and DuckDB read alike.

The tables hold no floor plans, so each view turns a whole table into rows of the shape that
a stage takes: graphs by shipping month, routes by order, sessions by user, shapes by part.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "f_lines": """
SELECT l_orderkey, l_partkey, l_suppkey, cast(year(l_shipdate) * 100 + month(l_shipdate) AS bigint) AS g,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS rn
FROM lineitem""",
    "f_nodes": """
SELECT concat('G', cast(g AS string)) AS graph_id, concat('S', lpad(cast(s AS string), 6, '0')) AS node_id, s AS ord,
  CASE s % 5 WHEN 0 THEN 'ROOM_ENTRY' WHEN 1 THEN 'CORRIDOR_INTERSECTION' WHEN 2 THEN 'DEAD_END' WHEN 3 THEN 'VERTICAL_CONNECTOR' ELSE 'BUILDING_ENTRY' END AS node_type,
  CASE WHEN s % 8 = 7 THEN NULL ELSE cast((s * 37 + g) % 100 AS double) END AS x,
  CASE WHEN s % 8 = 7 THEN NULL ELSE cast((s * 53 + g) % 100 AS double) END AS y
FROM (SELECT DISTINCT g FROM f_lines) m CROSS JOIN (SELECT s_suppkey AS s FROM supplier) t""",
    "f_edges": """
SELECT concat('G', cast(g AS string)) AS graph_id,
  concat('G', cast(g AS string), ':', cast(a AS string), '>', cast(b AS string)) AS edge_id,
  concat('S', lpad(cast(a AS string), 6, '0')) AS src, concat('S', lpad(cast(b AS string), 6, '0')) AS dst,
  cast(1 + (count(*) * 7 + a * 5 + b * 3) % 17 AS double) AS cost
FROM (SELECT g, lag(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY rn) AS a, l_suppkey AS b FROM f_lines) t
WHERE a IS NOT NULL AND a <> b GROUP BY g, a, b""",
    "f_origins": "SELECT graph_id, min(src) AS origin FROM f_edges GROUP BY graph_id",
    "f_contexts": "SELECT * FROM (VALUES (1, 'SHORTEST'), (2, 'FASTEST'), (3, 'ACCESSIBLE'), (4, 'AVOID_STAIRS'), (5, 'PREFER_ELEVATORS')) AS t(context_id, preference)",
    "f_graph_contexts": "SELECT graph_id, context_id, preference FROM f_origins CROSS JOIN f_contexts",
    "f_dirty_nodes": "SELECT DISTINCT o_orderpriority AS graph_id, concat('N', lpad(cast(n_nationkey AS string), 3, '0')) AS node_id FROM orders CROSS JOIN nation",
    "f_dirty_edges": """
SELECT o_orderpriority AS graph_id, o_orderkey AS edge_ord, concat('N', lpad(cast(o_custkey % 30 AS string), 3, '0')) AS src,
  concat('N', lpad(cast(o_orderkey % 27 AS string), 3, '0')) AS dst, cast(o_orderkey % 4 AS double) AS cost FROM orders""",
    "f_segments": """
SELECT l_orderkey AS route_id, rn AS sequence,
  coalesce(lag(target) OVER (PARTITION BY l_orderkey ORDER BY rn), concat('O', cast(l_orderkey AS string))) AS source, target
FROM (SELECT l_orderkey, rn, concat('P', cast(l_partkey AS string), '-', cast(rn AS string)) AS target FROM f_lines) t""",
    "f_routes": "SELECT o_orderkey AS route_id, concat('O', cast(o_orderkey AS string)) AS origin, cast(o_orderkey % 100 + 1 AS double) AS total_cost FROM orders",
    "f_calls": """
SELECT user_id AS session_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS call_no,
  CASE event_type WHEN 'view' THEN 'START' WHEN 'click' THEN 'PAUSE' WHEN 'signup' THEN 'RESUME' WHEN 'error' THEN 'CANCEL' ELSE 'COMPLETE' END AS action
FROM events""",
    "f_positions": """
SELECT event_id, user_id AS session_id, event_type AS source, ts AS recorded_at,
  concat('G', cast(199601 + event_id % 12 AS string)) AS graph_id,
  cast(cast(floor(value) AS bigint) % 100 AS double) AS x, cast(cast(regexp_extract(props, '[0-9]+', 0) AS int) AS double) AS y
FROM events""",
    "f_prims": """
SELECT import_id, ord, concat('el-', cast(ord AS string)) AS id, type, layer, x, y, w, h, r,
  CASE WHEN type = 'line' THEN x + w END AS x2, CASE WHEN type = 'line' THEN y + h END AS y2
FROM (SELECT p_partkey AS ord, import_id, k, CASE WHEN k % 5 < 2 THEN 'line' WHEN k % 5 = 3 THEN 'circle' ELSE 'rect' END AS type,
    CASE WHEN k % 10 = 9 THEN NULL ELSE p_brand END AS layer,
    cast(10 * (k % 40) AS double) AS x, cast(10 * (cast(floor(k / 40) AS bigint) % 25) AS double) AS y,
    cast(CASE k % 5 WHEN 0 THEN 10 WHEN 1 THEN 0 WHEN 2 THEN (k * 7) % 12 WHEN 4 THEN 40 END AS double) AS w,
    cast(CASE k % 5 WHEN 0 THEN 0 WHEN 1 THEN 10 WHEN 2 THEN (k * 3) % 9 WHEN 4 THEN 4 END AS double) AS h,
    cast(CASE WHEN k % 5 = 3 THEN k % 6 END AS double) AS r
  FROM (SELECT p_partkey, p_brand, cast(floor(p_partkey / 400) AS bigint) AS import_id,
      CASE WHEN p_partkey % 17 = 0 AND p_partkey % 400 >= 5 THEN p_partkey % 400 - 5 ELSE p_partkey % 400 END AS k FROM part) a) b""",
    "f_clean": """
SELECT import_id, ord, id, type, layer, x, y, w, h, r, x2, y2 FROM (SELECT *, row_number() OVER (PARTITION BY import_id, type, coalesce(layer, ''), x, y, coalesce(w, -1), coalesce(h, -1), coalesce(r, -1) ORDER BY ord) AS rn
  FROM f_prims WHERE NOT coalesce(CASE type WHEN 'circle' THEN r = 0 WHEN 'rect' THEN w = 0 OR h = 0 ELSE w = 0 AND h = 0 END, false)) t WHERE rn = 1""",
    "f_drawn": """
SELECT import_id, ord, concat('el-', cast(row_number() OVER (PARTITION BY import_id ORDER BY ord) - 1 AS string)) AS id, v, cast(10 * (k % 40) AS double) AS x, cast(10 * (cast(floor(k / 40) AS bigint) % 25) AS double) AS y, k, concat('L', cast(k % 3 AS string)) AS layer,
  CASE WHEN v < 2 THEN 'line' WHEN v = 2 THEN 'rect' WHEN v = 3 THEN 'circle' WHEN v = 4 THEN 'ellipse' WHEN v IN (5, 11) THEN 'polyline' WHEN v IN (6, 10) THEN 'polygon' WHEN v < 9 THEN 'path' ELSE 'text' END AS type
FROM (SELECT ord, import_id, k, k % 12 AS v FROM (SELECT p_partkey AS ord, cast(floor(p_partkey / 400) AS bigint) AS import_id,
    CASE WHEN p_partkey % 17 = 0 AND p_partkey % 400 >= 5 THEN p_partkey % 400 - 5 ELSE p_partkey % 400 END AS k FROM part) a) b""",
    "f_strokes": """
SELECT import_id, ord, id, type, layer, seg, x + ax AS x1, y + ay AS y1, x + bx AS x2, y + bz AS y2 FROM f_drawn
JOIN (SELECT * FROM (VALUES (0, 0, 0, 0, 10, 0), (1, 0, 0, 0, 0, 10), (2, 0, 0, 0, 40, 0), (2, 1, 40, 0, 40, 4), (2, 2, 40, 4, 0, 4), (2, 3, 0, 4, 0, 0),
  (5, 0, 0, 0, 10, 0), (5, 1, 10, 0, 10, 10), (6, 0, 0, 0, 10, 0), (6, 1, 10, 0, 10, 10), (6, 2, 10, 10, 0, 0), (7, 0, 0, 0, 10, 0), (7, 1, 10, 0, 10, 10), (7, 2, 10, 10, 0, 10), (7, 3, 0, 10, 0, 0),
  (8, 0, 0, 0, 10, 0), (8, 1, 10, 0, 10, 10), (8, 2, 10, 10, 12, 13), (8, 3, 12, 13, 13.5, 12.5), (11, 0, 0, 0, 0, 0)) AS t(w, seg, ax, ay, bx, bz)) s ON s.w = v
UNION ALL SELECT import_id, ord, id, type, layer, 4 + i, x + 13.5 + 0.25 * i, y + 12.5, x + 13.75 + 0.25 * i, y + 12.5 FROM f_drawn JOIN (SELECT CAST(n_nationkey AS int) AS i FROM nation) n ON v = 8 AND i < k % 23""",
    "f_shapes": """
SELECT import_id, ord, id, v, type, layer, x, y, k, n_segments, CASE WHEN v = 10 THEN 'missing or malformed' WHEN flat THEN 'zero-length or degenerate' WHEN rn > 1 THEN 'duplicate' END AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY import_id, type, layer, flat, v = 10, CASE WHEN type = 'path' THEN concat('n', cast(n_segments AS string)) ELSE concat(cast(v AS string), '/', cast(x AS string), '/', cast(y AS string), '/', cast(CASE WHEN v = 3 THEN k % 6 WHEN v = 4 THEN k % 7 ELSE 0 END AS string)) END ORDER BY ord) AS rn
  FROM (SELECT d.*, coalesce(n, 0) AS n_segments, v = 11 OR (v = 3 AND k % 6 = 0) OR (v = 4 AND k % 7 = 0) AS flat FROM f_drawn d LEFT JOIN (SELECT ord AS o, count(*) AS n FROM f_strokes GROUP BY ord) s ON s.o = d.ord) a) b""",
    "f_objects": """
SELECT c_custkey AS uso_id, CASE c_custkey % 6 WHEN 0 THEN 'BOUNDARY' WHEN 1 THEN 'WALL' WHEN 2 THEN 'ENCLOSURE'
  WHEN 3 THEN 'OPENING' WHEN 4 THEN 'PASSAGE' ELSE 'VERTICAL_CONNECTION' END AS spatial_category FROM customer""",
    "f_rel": """
SELECT o_orderkey AS ord, o_custkey AS src, (o_custkey + o_orderkey * 7) % 1600 AS dst,
  CASE o_orderkey % 5 WHEN 0 THEN 'CONTAINS' WHEN 1 THEN 'ADJACENT' WHEN 3 THEN 'INTERSECTS' ELSE 'TOUCHES' END AS candidate_type FROM orders""",
    "f_rules": """
SELECT * FROM (VALUES ('SEM-001', 'WALL', 'STRUCTURAL_WALL', 100, 1), ('SEM-002', 'PASSAGE', 'CORRIDOR', 100, 2),
  ('SEM-003', 'OPENING', 'DOORWAY', 100, 3), ('SEM-004', 'ENCLOSURE', 'ROOM', 100, 4),
  ('SEM-005', 'VERTICAL_CONNECTION', 'VERTICAL_CONNECTOR', 100, 5)) AS t(rule_id, spatial_category, semantic_category, priority, rule_ord)""",
    "f_more_rules": "SELECT * FROM f_rules UNION ALL SELECT * FROM (VALUES ('SEM-101', 'WALL', 'PARTITION', 150, 6), ('SEM-102', 'PASSAGE', 'RAMP', 50, 7), ('SEM-103', 'ENCLOSURE', 'HALL', 100, 8)) AS t(rule_id, spatial_category, semantic_category, priority, rule_ord)",
    "f_rule_versions": """
SELECT * FROM (VALUES ('SEM-001', 1, 'WALL', 'STRUCTURAL_WALL', 100, 1, true, 0, 40), ('SEM-001', 2, 'WALL', 'LOAD_BEARING_WALL', 100, 1, true, 40, NULL), ('SEM-002', 1, 'PASSAGE', 'CORRIDOR', 100, 2, true, NULL, 70),
  ('SEM-003', 1, 'OPENING', 'DOORWAY', 100, 3, false, NULL, NULL), ('SEM-003', 2, 'OPENING', 'GATE', 90, 3, true, 10, 90), ('SEM-004', 1, 'ENCLOSURE', 'ROOM', 100, 4, true, NULL, 50), ('SEM-004', 2, 'ENCLOSURE', 'CHAMBER', 100, 4, true, 30, NULL),
  ('SEM-005', 3, 'VERTICAL_CONNECTION', 'VERTICAL_CONNECTOR', 100, 5, true, 20, NULL), ('SEM-104', 1, 'ENCLOSURE', 'HALL', 150, 6, true, 45, 48)) AS t(rule_id, version, spatial_category, semantic_category, priority, rule_ord, enabled, valid_from, valid_to)""",
    "f_made_objects": "SELECT uso_id, spatial_category, cast(uso_id * 7 % 100 AS int) AS made_at FROM f_objects",
    "f_candidates": """
SELECT p_partkey AS ord, CASE p_partkey % 6 WHEN 0 THEN 'candidateBoundaries' WHEN 1 THEN 'candidateEnclosures' WHEN 2 THEN 'candidateOpenings' WHEN 3 THEN 'candidateWalls' WHEN 4 THEN 'candidatePassages' ELSE 'candidateVerticalConnections' END AS collection,
  CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 10 < 5 THEN concat('c-', cast(cast(floor(p_partkey / 12) AS bigint) AS string)) ELSE concat('p-', cast(p_partkey AS string)) END AS candidate_id,
  CASE WHEN p_partkey % 4 > 0 THEN concat('el-', cast(p_partkey AS string)) END AS primitive_id, CASE WHEN p_partkey % 3 = 0 THEN concat('el-', cast(p_partkey + 1 AS string)) END AS partner_id FROM part""",
    "f_semantic_input": """
SELECT c_custkey AS ord, CASE WHEN c_custkey % 19 = 0 THEN NULL WHEN c_custkey % 10 = 1 THEN c_custkey - 1 ELSE c_custkey END AS uso_id,
  CASE c_custkey % 7 WHEN 0 THEN 'BOUNDARY' WHEN 1 THEN 'WALL' WHEN 2 THEN 'ENCLOSURE' WHEN 3 THEN 'OPENING' WHEN 4 THEN 'PASSAGE' WHEN 5 THEN 'VERTICAL_CONNECTION' ELSE 'UNKNOWN' END AS spatial_category FROM customer""",
    "f_raw_positions": """
SELECT event_id, CASE WHEN event_id % 17 > 0 THEN graph_id END AS graph_id, CASE WHEN event_id % 19 > 0 THEN source END AS source,
  CASE WHEN event_id % 23 > 0 THEN recorded_at END AS recorded_at, CASE WHEN event_id % 29 > 0 THEN x END AS x, CASE WHEN event_id % 29 > 1 THEN y END AS y FROM f_positions""",
    "f_graph_candidates": """
SELECT o_orderpriority AS graph_id, o_orderkey AS candidate_id, CASE WHEN o_orderkey % 31 = 0 THEN -o_custkey ELSE o_orderkey END AS object_id,
  CASE o_orderkey % 3 WHEN 0 THEN 'ROOM_ENTRY' WHEN 1 THEN 'DEAD_END' WHEN 2 THEN 'BUILDING_ENTRY' END AS candidate_type FROM orders""",
    "f_graph_nodes": """
SELECT graph_id, CASE WHEN candidate_id % 37 = 0 THEN -1 ELSE candidate_id END AS candidate_id, object_id, CASE WHEN candidate_id % 41 > 0 THEN candidate_type END AS node_type
FROM f_graph_candidates WHERE NOT (candidate_id % 29 = 0 AND graph_id = '1-URGENT')""",
    "f_stops": "SELECT l_orderkey AS route_id, rn AS place, l_suppkey AS node FROM f_lines",
    "f_links": """
SELECT DISTINCT node AS src, nxt AS dst, cast((node * 5 + nxt * 3) % 17 AS double) AS cost
FROM (SELECT node, lead(node) OVER (PARTITION BY route_id ORDER BY place) AS nxt FROM f_stops) t WHERE nxt IS NOT NULL AND (node + nxt) % 23 > 0""",
    "f_kinds": """
SELECT o_custkey AS request_id, o_orderkey AS route_id, cast(o_orderkey % 7 AS int) AS context_id,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE CASE o_orderkey % 5 WHEN 0 THEN 'SHORTEST' WHEN 1 THEN 'FASTEST' WHEN 2 THEN 'ACCESSIBLE' WHEN 3 THEN 'AVOID_STAIRS' ELSE 'PREFER_ELEVATORS' END END AS preference FROM orders""",
    "f_hops": """
SELECT t.route_id, t.place, t.node, t.nxt, e.cost AS base_cost, CASE WHEN k.preference = 'ACCESSIBLE' THEN e.cost * 2 WHEN k.preference = 'AVOID_STAIRS' AND e.dst % 5 = 3 THEN e.cost + 3 ELSE e.cost END AS cost
FROM (SELECT route_id, place, node, lead(node) OVER (PARTITION BY route_id ORDER BY place) AS nxt FROM f_stops) t
JOIN f_kinds k ON k.route_id = t.route_id LEFT JOIN f_links e ON e.src = t.node AND e.dst = t.nxt""",
    "f_offers": """
SELECT k.request_id, k.route_id, k.context_id, k.preference, s.n_hops + CASE WHEN k.route_id % 11 = 0 THEN 1 ELSE 0 END AS hop_count,
  s.summed + CASE WHEN k.route_id % 13 = 0 THEN 1 ELSE 0 END AS total_cost
FROM f_kinds k JOIN (SELECT route_id, count(nxt) AS n_hops, coalesce(sum(cost), cast(0 AS double)) AS summed FROM f_hops GROUP BY route_id) s ON s.route_id = k.route_id""",
    "f_asked": """
SELECT r.request_id, min(CASE WHEN s.place = 1 THEN s.node END) AS origin, min(CASE WHEN s.place = r.n THEN s.node END) AS destination
FROM (SELECT k.request_id, k.route_id, (SELECT max(place) FROM f_stops z WHERE z.route_id = k.route_id) AS n FROM (SELECT request_id, min(route_id) AS route_id FROM f_offers GROUP BY request_id) k) r
JOIN f_stops s ON s.route_id = r.route_id GROUP BY r.request_id""",
}


def _used(sql: str) -> list[str]:
    """Views that a text needs, those first that others stand on."""
    found: list[str] = []
    for name in VIEWS:
        if re.search(rf"\b{name}\b", sql):
            found += [x for x in _used(VIEWS[name]) + [name] if x not in found]
    return found


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view, or a given table, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    for other in (*TABLES, *VIEWS):
        if re.search(rf"\b{other}\b", text):
            view(spark, sf_dir, other).createOrReplaceTempView(other)
    return spark.sql(text)


def oracle(sql: str) -> str:
    """DuckDB text: the views that `sql` uses, before its own common tables."""
    sql = sql.strip()
    own = re.sub(r"^WITH\s+(RECURSIVE\s+)?", "", sql) if sql.upper().startswith("WITH") else None
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in _used(sql))
    if not views:
        return sql
    return f"WITH RECURSIVE {views}" + (f",\n{own}" if own else f"\n{sql}")
