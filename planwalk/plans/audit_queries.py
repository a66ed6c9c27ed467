"""Audits over inputs with faults in them: candidates, objects, positions, nodes, edges, routes and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planwalk.functions import geometry
from planwalk.operators import audits, objects, routing, sessions, shapes
from planwalk.plans.graph_queries import written_edges
from planwalk.plans.object_queries import _models
from planwalk.plans.session_queries import _REPORTS, _STEPS, _TOTALS, _reports, _snapshots
from planwalk.plans.shape_queries import _BOX
from planwalk.plans.views import oracle, view
from planwalk.registry import register
from planwalk.sources.scratch import written

_REASONS = """firsts AS (SELECT collection, candidate_id, min(ord) AS fst FROM f_candidates WHERE candidate_id IS NOT NULL AND coalesce(primitive_id, partner_id) IS NOT NULL GROUP BY collection, candidate_id),
reasons AS (SELECT c.*, CASE WHEN c.candidate_id IS NULL THEN 'missing_id' WHEN c.ord > f.fst THEN 'duplicate' WHEN coalesce(primitive_id, partner_id) IS NULL THEN 'empty_reference' END AS reason
  FROM f_candidates c LEFT JOIN firsts f ON f.collection = c.collection AND f.candidate_id = c.candidate_id)"""
_REFERENCES = ("primitive_id", "partner_id")


@register(oracle(f"WITH {_REASONS} SELECT ord, collection, candidate_id, reason FROM reasons"))
def candidate_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why candidates are skipped; null for those that stay."""
    return audits.candidate_reasons(view(spark, sf_dir, "f_candidates"), *_REFERENCES).select("ord", "collection", "candidate_id", "reason")


@register(oracle(f"WITH {_REASONS} SELECT collection, count(*) AS n_candidates, count(reason) AS n_skipped FROM reasons GROUP BY collection"))
def candidate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates and skipped ones of each collection."""
    found = audits.candidate_reasons(view(spark, sf_dir, "f_candidates"), *_REFERENCES)
    return found.groupBy("collection").agg(F.count(F.lit(1)).alias("n_candidates"), F.count("reason").alias("n_skipped"))


@register(
    oracle(
        f"""WITH {_REASONS} SELECT collection, candidate_id, CASE collection WHEN 'candidateBoundaries' THEN 'BOUNDARY' WHEN 'candidateEnclosures' THEN 'ENCLOSURE' WHEN 'candidateOpenings' THEN 'OPENING' WHEN 'candidateWalls' THEN 'WALL'
  WHEN 'candidatePassages' THEN 'PASSAGE' ELSE 'VERTICAL_CONNECTION' END AS spatial_category, concat_ws(',', primitive_id, partner_id) AS primitive_ids FROM reasons WHERE reason IS NULL"""
    )
)
def object_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One object for each candidate that stays, with its category and the shapes it refers to."""
    return audits.objects_of(view(spark, sf_dir, "f_candidates"), *_REFERENCES).withColumn("primitive_ids", F.array_join("primitive_ids", ","))


@register(
    oracle(
        """WITH firsts AS (SELECT uso_id, min(ord) AS fst FROM f_semantic_input WHERE uso_id IS NOT NULL GROUP BY uso_id)
SELECT i.ord, i.uso_id, CASE WHEN i.uso_id IS NULL THEN 'missing_id' WHEN i.ord > fst THEN 'duplicate' WHEN spatial_category = 'UNKNOWN' THEN 'missing_accessibility'
  WHEN i.uso_id IN (SELECT uso_id FROM f_objects WHERE spatial_category = 'OPENING') THEN 'already_modelled' END AS reason FROM f_semantic_input i LEFT JOIN firsts f ON f.uso_id = i.uso_id"""
    )
)
def semantic_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why objects are not classified; null for those that are.  Openings have models already."""
    done = view(spark, sf_dir, "f_objects").where("spatial_category = 'OPENING'")
    return audits.semantic_input_reasons(objects.accessibility(view(spark, sf_dir, "f_semantic_input")), done)


@register(
    oracle(
        """SELECT 'missing_graph_id' AS check_name, event_id FROM f_raw_positions WHERE graph_id IS NULL UNION ALL SELECT 'missing_source', event_id FROM f_raw_positions WHERE source IS NULL
UNION ALL SELECT 'missing_recorded_at', event_id FROM f_raw_positions WHERE recorded_at IS NULL UNION ALL SELECT 'missing_coordinates', event_id FROM f_raw_positions WHERE x IS NULL AND y IS NULL"""
    )
)
def position_shape_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings without graph, source, time or coordinates."""
    return audits.position_audit(view(spark, sf_dir, "f_raw_positions"), "event_id")


@register(oracle("SELECT graph_id, candidate_id, object_id, candidate_type AS node_type FROM f_graph_candidates"))
def node_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node for each navigation candidate."""
    return view(spark, sf_dir, "f_graph_candidates").withColumnRenamed("candidate_type", "node_type")


@register(
    oracle(
        """SELECT 'count' AS check_name, c.graph_id, cast(NULL AS bigint) AS key FROM (SELECT graph_id, count(*) AS n FROM f_graph_candidates GROUP BY graph_id) c
  LEFT JOIN (SELECT graph_id, count(*) AS n FROM f_graph_nodes GROUP BY graph_id) n ON n.graph_id = c.graph_id WHERE c.n <> coalesce(n.n, 0)
UNION ALL SELECT 'missing_type', graph_id, candidate_id FROM f_graph_nodes WHERE node_type IS NULL
UNION ALL SELECT 'duplicate_candidate', graph_id, candidate_id FROM f_graph_nodes GROUP BY graph_id, candidate_id HAVING count(*) > 1
UNION ALL SELECT 'duplicate_object', graph_id, object_id FROM f_graph_nodes GROUP BY graph_id, object_id HAVING count(*) > 1"""
    )
)
def node_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes that do not fit their candidates."""
    return audits.node_audit(view(spark, sf_dir, "f_graph_candidates"), view(spark, sf_dir, "f_graph_nodes"))


@register(
    oracle(
        """WITH e AS (SELECT * FROM f_dirty_edges WHERE graph_id <> '5-LOW'), n AS (SELECT * FROM f_dirty_nodes WHERE graph_id <> '5-LOW')
SELECT 'foreign_graph' AS check_name, graph_id, edge_ord FROM f_dirty_edges WHERE graph_id = '5-LOW'
UNION ALL SELECT 'orphan_source', graph_id, edge_ord FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.graph_id = e.graph_id AND n.node_id = e.src)
UNION ALL SELECT 'orphan_target', graph_id, edge_ord FROM e WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.graph_id = e.graph_id AND n.node_id = e.dst)
UNION ALL SELECT 'self_loop', graph_id, edge_ord FROM e WHERE src = dst
UNION ALL SELECT 'duplicate', graph_id, edge_ord FROM (SELECT graph_id, edge_ord, row_number() OVER (PARTITION BY graph_id, src, dst ORDER BY edge_ord) AS rn FROM e) t WHERE rn > 1"""
    )
)
def edge_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of graphs that are not asked for, and faults of the others."""
    nodes = view(spark, sf_dir, "f_dirty_nodes").where("graph_id <> '5-LOW'")
    return audits.edge_audit(nodes.select("graph_id").distinct(), nodes, view(spark, sf_dir, "f_dirty_edges"), "edge_ord")


def _policy() -> Column:
    """The policies of f_hops: twice the cost for ACCESSIBLE, three more into every fifth node for AVOID_STAIRS."""
    cost = F.col("cost")
    return F.when(F.col("preference") == "ACCESSIBLE", cost * 2).when((F.col("preference") == "AVOID_STAIRS") & (F.col("next") % 5 == 3), cost + 3).otherwise(cost)


_OFFERED = """facts AS (SELECT route_id, arg_min(node, place) AS fst, arg_max(node, place) AS lst, count(nxt) AS n_hops, count_if(nxt IS NOT NULL AND base_cost IS NULL) AS n_missing, count_if(base_cost IS NOT NULL AND NOT cost > 0) AS n_bad,
  coalesce(sum(CASE WHEN cost > 0 THEN cost END), 0) AS summed FROM f_hops GROUP BY route_id),
m AS (SELECT o.*, a.origin, a.destination, f.fst, f.lst, f.n_hops, f.n_missing, f.n_bad, f.summed, c.context_id IS NOT NULL AS wanted, o.preference IS NOT NULL AS whole, lag(o.context_id) OVER (PARTITION BY o.request_id ORDER BY o.route_id) AS before,
  row_number() OVER (PARTITION BY o.request_id, o.context_id ORDER BY o.route_id) AS nc, row_number() OVER (PARTITION BY o.request_id, o.preference ORDER BY o.route_id) AS np
  FROM f_offers o JOIN facts f ON f.route_id = o.route_id LEFT JOIN f_asked a ON a.request_id = o.request_id LEFT JOIN f_contexts c ON c.context_id = o.context_id)"""
_OFFER_FAULTS = """SELECT 'missing_field' AS check_name, request_id, route_id FROM m WHERE NOT whole UNION ALL SELECT 'foreign_context', request_id, route_id FROM m WHERE NOT wanted
UNION ALL SELECT 'duplicate_context', request_id, route_id FROM m WHERE nc > 1 UNION ALL SELECT 'duplicate_preference', request_id, route_id FROM m WHERE np > 1
UNION ALL SELECT 'origin', request_id, route_id FROM m WHERE whole AND fst <> origin UNION ALL SELECT 'destination', request_id, route_id FROM m WHERE whole AND lst <> destination
UNION ALL SELECT 'hop_count', request_id, route_id FROM m WHERE whole AND hop_count <> n_hops UNION ALL SELECT 'missing_edge', request_id, route_id FROM m WHERE whole AND n_missing > 0
UNION ALL SELECT 'bad_cost', request_id, route_id FROM m WHERE whole AND n_bad > 0 UNION ALL SELECT 'cost_sum', request_id, route_id FROM m WHERE whole AND n_missing + n_bad = 0 AND abs(summed - total_cost) > 1e-9
UNION ALL SELECT DISTINCT 'order', request_id, cast(NULL AS bigint) FROM m WHERE NOT wanted OR context_id <= before"""


@register(oracle(f"WITH {_OFFERED} {_OFFER_FAULTS}"))
def routing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of the routes offered in reply to each customer's request, under policies that change costs."""
    routes, stops, asked, contexts, links = (view(spark, sf_dir, n) for n in ("f_offers", "f_stops", "f_asked", "f_contexts", "f_links"))
    return audits.routing_audit(routes, stops, asked, contexts, links, _policy())


@register(
    oracle(
        f"""WITH {_STEPS}, {_REPORTS},
shot AS (SELECT s.session_id, s.call_no, s.step, r.total, CASE WHEN call_no % 13 > 0 THEN node END AS node, CASE WHEN s.step > 0 THEN s.step END AS segment, CASE WHEN call_no % 11 = 0 THEN 'PAUSED' ELSE 'ACTIVE' END AS state,
  total - s.step - CASE WHEN call_no % 17 = 0 THEN total ELSE 0 END AS remaining, total_cost / total * (total - s.step) AS cost, s.step / total * 100 + CASE WHEN call_no % 19 = 0 THEN 10 ELSE 0 END AS pct, (s.step = total) <> (call_no % 23 = 0) AS done
  FROM steps s JOIN rep r ON r.route_id = s.session_id AND r.step = s.step),
told AS (SELECT session_id, call_no, unnest([CASE WHEN state <> 'ACTIVE' THEN 'state' END, CASE WHEN node IS NULL THEN 'no_node' END, CASE WHEN segment IS NULL THEN 'no_segment' END, CASE WHEN remaining < 0 THEN 'remaining_segments' END,
  CASE WHEN done AND remaining > 0 THEN 'completed_with_segments' END, CASE WHEN done AND cost > 1e-9 THEN 'completed_with_cost' END, CASE WHEN pct > 100 THEN 'percentage_range' END,
  CASE WHEN pct <= 100 AND done AND abs(pct - 100) >= 1e-9 THEN 'completed_below_100' END, CASE WHEN pct <= 100 AND NOT done AND abs(pct - 100) < 1e-9 THEN 'full_not_completed' END, CASE WHEN call_no % 19 = 0 THEN 'step_percentage' END]) AS check_name FROM shot)
SELECT * FROM told WHERE check_name IS NOT NULL"""
    )
)
def runtime_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of all snapshots, into which some calls bring wrong states, nodes, remainders, percentages and ends."""
    n, shots = F.col("call_no"), _snapshots(spark, sf_dir)
    total = F.col("step") + F.col("remaining_segments")
    faulty = shots.withColumn("total", total).withColumns(
        {
            "state": F.when(n % 11 == 0, "PAUSED").otherwise("ACTIVE"),
            "current_node": F.when(n % 13 > 0, F.col("current_node")),
            "remaining_segments": F.col("remaining_segments") - F.when(n % 17 == 0, F.col("total")).otherwise(0),
            "percentage": F.col("percentage") + F.when(n % 19 == 0, 10).otherwise(0),
            "completed": F.col("completed") != (n % 23 == 0),
        }
    )
    return audits.runtime_audit(faulty, "session_id", "call_no")


_ROUNDS = 24
_PRICED = """priced AS MATERIALIZED (SELECT e.graph_id, preference, src, dst, CASE WHEN node_type = 'VERTICAL_CONNECTOR' AND preference = 'AVOID_STAIRS' THEN cost + 10 WHEN preference = 'ACCESSIBLE' THEN cost * 2 ELSE cost END AS cost
  FROM f_edges e JOIN f_nodes n ON n.graph_id = e.graph_id AND n.node_id = e.dst CROSS JOIN f_contexts),
r0 AS (SELECT graph_id, preference, origin AS node, cast(0 AS double) AS d FROM f_origins CROSS JOIN f_contexts),
""" + ",\n".join(
    f"r{k} AS MATERIALIZED (SELECT graph_id, preference, node, min(d) AS d FROM (SELECT * FROM r{k - 1} UNION ALL SELECT e.graph_id, e.preference, e.dst, r.d + e.cost FROM r{k - 1} r JOIN priced e ON e.graph_id = r.graph_id AND e.preference = r.preference AND e.src = r.node) t GROUP BY graph_id, preference, node)"
    for k in range(1, _ROUNDS + 1)
)


#: What an edge costs under a preference, by the type of the node that it leads to.
POLICIES = {"ACCESSIBLE": "cost * 2", "AVOID_STAIRS": "CASE WHEN node_type = 'VERTICAL_CONNECTOR' THEN cost + 10 ELSE cost END"}


def _policies() -> dict[str, Column]:
    return {preference: F.expr(price) for preference, price in POLICIES.items()}


def _typed_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges with the type of the node that they lead to, origins, contexts of each graph)."""
    edges, origins = written_edges(spark, sf_dir)
    kinds = view(spark, sf_dir, "f_nodes").select("graph_id", F.col("node_id").alias("dst"), "node_type")
    contexts = written(origins.select("graph_id").crossJoin(view(spark, sf_dir, "f_contexts")), "contexts")
    return edges.join(kinds, ["graph_id", "dst"]), origins, contexts


@register(oracle(f"WITH {_PRICED} SELECT graph_id, preference, node AS node_id, d AS cost FROM r{_ROUNDS}"))
def policy_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest costs from each graph's origin under every preference, searched over the costs that its policy gives."""
    edges, origins, contexts = _typed_edges(spark, sf_dir)
    kinds = contexts.withColumn("policy", routing.policy_of(_policies()))
    starts = origins.join(kinds, "graph_id").select("graph_id", "policy", "origin")
    found = routing.shortest_costs(routing.policy_costs(edges, contexts, _policies()), starts, ("graph_id", "policy"))
    return found.join(kinds, ["graph_id", "policy"]).select("graph_id", "preference", "node_id", "cost")


_ROUTES = f"""{_PRICED},
ptree AS MATERIALIZED (SELECT v.graph_id, v.preference, v.node, v.d, min(u.node) AS pred FROM r{_ROUNDS} v
  LEFT JOIN priced e ON e.graph_id = v.graph_id AND e.preference = v.preference AND e.dst = v.node
  LEFT JOIN r{_ROUNDS} u ON u.graph_id = e.graph_id AND u.preference = e.preference AND u.node = e.src AND u.d + e.cost = v.d
  WHERE v.d = 0 OR u.node IS NOT NULL GROUP BY v.graph_id, v.preference, v.node, v.d),
pfar AS (SELECT graph_id, preference, max(node) AS dest FROM ptree GROUP BY graph_id, preference),
pwalk AS (SELECT graph_id, preference, dest, dest AS node, 0 AS back FROM pfar
  UNION ALL SELECT w.graph_id, w.preference, w.dest, t.pred, w.back + 1 FROM pwalk w JOIN ptree t ON t.graph_id = w.graph_id AND t.preference = w.preference AND t.node = w.node WHERE t.pred IS NOT NULL),
ways AS (SELECT w.graph_id, w.preference, string_agg(w.node, '>' ORDER BY back DESC) AS route, max(back) AS hop_count, max(t.d) AS total_cost FROM pwalk w
  JOIN ptree t ON t.graph_id = w.graph_id AND t.preference = w.preference AND t.node = w.dest GROUP BY w.graph_id, w.preference)"""


def _preference_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes from each graph's origin to its last reachable node under each of its contexts."""
    # what is reachable does not depend on the policy: costs stay positive
    edges, origins, contexts = _typed_edges(spark, sf_dir)
    reach = routing.shortest_costs(edges, origins).groupBy("graph_id", "origin").agg(F.max("node_id").alias("destination"))
    return routing.preference_routes(edges, contexts, written(reach, "reach"), _policies())


@register(oracle(f"WITH {_ROUTES} SELECT w.graph_id, c.context_id, cast(c.context_id AS integer) AS place, w.preference, route, cast(hop_count AS bigint) AS hop_count, total_cost FROM ways w JOIN f_contexts c ON c.preference = w.preference"))
def preference_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest route of each graph under each context's policy, in the order of the contexts."""
    return _preference_routes(spark, sf_dir).select("graph_id", "context_id", "place", "preference", F.array_join("path", ">").alias("route"), "hop_count", "total_cost")


@register(
    oracle(
        f"""WITH {_ROUTES} SELECT graph_id, count(*) AS n_routes, count(DISTINCT preference) AS n_preferences, count(DISTINCT route) AS n_ways, min(total_cost) AS min_cost, round(avg(total_cost), 6) AS avg_cost, round(avg(hop_count), 6) AS avg_hops
FROM ways GROUP BY graph_id"""
    )
)
def route_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes, preferences, different ways, least and mean cost and mean hops of each graph's comparison."""
    found = routing.comparison_summary(_preference_routes(spark, sf_dir))
    return found.withColumn("avg_cost", F.round("avg_cost", 6)).withColumn("avg_hops", F.round("avg_hops", 6))


@register(
    oracle(
        """WITH m AS (SELECT o.uso_id, r.semantic_category AS c, CASE WHEN r.rule_id IS NULL THEN 0 ELSE 1 END AS conf FROM f_objects o LEFT JOIN f_rules r ON r.spatial_category = o.spatial_category),
f AS (SELECT CASE WHEN uso_id % 17 = 0 THEN -uso_id WHEN uso_id % 19 = 0 THEN uso_id - 1 ELSE uso_id END AS uso_id, c, CASE WHEN uso_id % 23 = 0 THEN 1.5 WHEN uso_id % 29 = 0 THEN 0 ELSE conf END AS conf FROM m)
SELECT 'orphan' AS check_name, uso_id FROM f WHERE uso_id NOT IN (SELECT uso_id FROM f_objects) UNION ALL SELECT 'duplicate', uso_id FROM f GROUP BY uso_id HAVING count(*) > 1
UNION ALL SELECT 'confidence_range', uso_id FROM f WHERE conf > 1 UNION ALL SELECT 'no_confidence', uso_id FROM f WHERE c IS NOT NULL AND conf = 0"""
    )
)
def semantic_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the semantic audit finds in models of which some have wrong objects and confidences."""
    u = F.col("uso_id")
    conf = F.when(u % 23 == 0, 1.5).when(u % 29 == 0, 0.0).otherwise(F.col("confidence"))
    faulty = _models(spark, sf_dir).withColumn("confidence", conf).withColumn("uso_id", F.when(u % 17 == 0, -u).when(u % 19 == 0, u - 1).otherwise(u))
    return objects.semantic_audit(view(spark, sf_dir, "f_objects"), faulty)


@register(
    oracle(
        f"""WITH {_TOTALS}, {_REPORTS}, f AS (SELECT route_id, step, total, step / total * 100 + CASE WHEN route_id % 7 = 0 THEN 30 ELSE 0 END AS pct, total - step + CASE WHEN route_id % 11 = 0 THEN 1 ELSE 0 END AS remaining,
  CASE WHEN step > 0 AND route_id % 13 > 0 THEN step END AS segment, step = total AS done FROM rep)
SELECT 'percentage_range' AS check_name, route_id, step FROM f WHERE pct > 100 UNION ALL SELECT 'remaining_segments', route_id, step FROM f WHERE remaining <> total - step
UNION ALL SELECT 'completed', route_id, step FROM f WHERE done <> (pct = 100) UNION ALL SELECT 'no_segment', route_id, step FROM f WHERE step > 0 AND segment IS NULL"""
    )
)
def progress_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the progress audit finds in reports of which some have wrong percentages, remainders and segments."""
    r = F.col("route_id")
    faulty = _reports(spark, sf_dir).withColumns(
        {
            "percentage": F.col("percentage") + F.when(r % 7 == 0, 30).otherwise(0),
            "remaining_segments": F.col("remaining_segments") + F.when(r % 11 == 0, 1).otherwise(0),
            "current_segment": F.when(r % 13 > 0, F.col("current_segment")),
        }
    )
    return sessions.progress_audit(faulty, sessions.totals(view(spark, sf_dir, "f_segments")))


@register(
    oracle(
        """WITH p AS (SELECT route_id AS destination, arg_min(node, place) AS fst, arg_max(node, place) AS lst, count(nxt) AS n_hops, count_if(nxt IS NOT NULL AND base_cost IS NULL) AS missing, coalesce(sum(base_cost), 0) AS cost FROM f_hops GROUP BY route_id)
SELECT 'endpoints' AS check_name, destination AS route_id FROM p WHERE destination % 7 = 0
UNION ALL SELECT DISTINCT 'unknown_node', route_id FROM f_stops WHERE node % 10 = 0
UNION ALL SELECT 'missing_edge', destination FROM p WHERE missing > 0
UNION ALL SELECT 'cost_sum', destination FROM p WHERE n_hops > 0 AND missing = 0 AND destination % 13 = 0"""
    )
)
def path_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the path audit finds in routes through the suppliers of an order, of which some have wrong ends, nodes, edges or costs."""
    hops = view(spark, sf_dir, "f_hops")
    stops = hops.groupBy("route_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "node"))), lambda s: s["node"]).alias("path"), F.coalesce(F.sum("base_cost"), F.lit(0.0)).alias("cost"))
    first = F.element_at("path", 1)
    found = stops.select(
        F.col("route_id"), F.when(F.col("route_id") % 7 == 0, -first - 1).otherwise(first).alias("origin"), F.element_at("path", -1).alias("destination"), "path", (F.col("cost") + F.when(F.col("route_id") % 13 == 0, 1).otherwise(0)).alias("total_cost")
    )
    known = found.select("route_id", F.explode("path").alias("node_id")).distinct().where("node_id % 10 > 0")
    links = hops.where("base_cost IS NOT NULL").select("route_id", F.col("node").alias("src"), F.col("nxt").alias("dst"), F.col("base_cost").alias("cost")).distinct()
    return routing.path_audit(found, known, links, ("route_id",)).select("check_name", "route_id")


@register(oracle(f"WITH b AS (SELECT import_id, {_BOX} FROM f_clean) SELECT import_id, count(*) AS n_shapes, min(x0) AS min_x, min(y0) AS min_y, max(x1) AS max_x, max(y1) AS max_y FROM b GROUP BY import_id"))
def plan_extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of each plan after cleaning, and the box around them."""
    return shapes.extent(shapes.clean(view(spark, sf_dir, "f_prims")))


@register(
    oracle(
        """SELECT import_id, id, CASE type WHEN 'line' THEN 'LineString' WHEN 'circle' THEN 'Point' ELSE 'Polygon' END AS kind, cast(CASE type WHEN 'line' THEN 2 WHEN 'circle' THEN 1 ELSE 5 END AS int) AS n_points,
  x AS first_x, y AS first_y, CASE type WHEN 'line' THEN x2 ELSE x END AS last_x, CASE type WHEN 'line' THEN y2 ELSE y END AS last_y FROM f_prims"""
    )
)
def geojson_geometries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes written as GeoJSON geometries and read back."""
    at = lambda x, y: F.concat(F.lit("["), F.expr(x).cast("string"), F.lit(","), F.expr(y).cast("string"), F.lit("]"))
    ring = F.concat_ws(",", at("x", "y"), at("x + w", "y"), at("x + w", "y + h"), at("x", "y + h"), at("x", "y"))
    kind = F.when(F.col("type") == "line", "LineString").when(F.col("type") == "circle", "Point").otherwise("Polygon")
    inner = F.when(kind == "Point", at("x", "y")).when(kind == "LineString", F.concat(F.lit("["), at("x", "y"), F.lit(","), at("x2", "y2"), F.lit("]"))).otherwise(F.concat(F.lit("[["), ring, F.lit("]]")))
    text = F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), inner, F.lit("}"))
    told, points = geometry.geojson_points(text)
    rows = view(spark, sf_dir, "f_prims").select("import_id", "id", told.alias("kind"), points.alias("p"))
    first, last = F.element_at("p", 1), F.element_at("p", -1)
    return rows.select("import_id", "id", "kind", F.size("p").alias("n_points"), *(e[c].alias(f"{n}_{c}") for n, e in (("first", first), ("last", last)) for c in "xy"))
