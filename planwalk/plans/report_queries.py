"""Validation of whole replies and written batches with their reports, verdicts on written geometries, whole models of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planwalk.functions import geometry
from planwalk.operators import audits, reports
from planwalk.plans.audit_queries import _OFFER_FAULTS, _OFFERED, _policy
from planwalk.plans.session_queries import _FAULTY, _faulty_batches, _snapshots, called
from planwalk.plans.svg_queries import documents
from planwalk.plans.views import oracle, view
from planwalk.registry import register
from planwalk.sources import svg
from planwalk.sources.scratch import written

_BY = ("session_id", "call_no")

#: Events with the session and the route that they name, and the snapshots of the same calls.
_TOLD = f"""{_FAULTY},
evs AS (SELECT *, CASE WHEN call_no % 3 = 0 AND place = 1 THEN session_id + 1 ELSE session_id END AS event_session, CASE WHEN call_no % 5 = 0 AND place = 0 THEN NULL ELSE session_id END AS event_route FROM o),
ends AS (SELECT session_id, call_no, count(*) AS n, max(event_type = 'DestinationReached') AS reached, max(event_type = 'SessionCancelled') AS cancelled FROM evs GROUP BY session_id, call_no),
shot AS (SELECT s.session_id, s.call_no, s.step, t.total, CASE WHEN s.call_no % 13 > 0 THEN node END AS node, CASE WHEN s.call_no % 11 = 0 THEN 'CANCELLED' ELSE 'ACTIVE' END AS state, t.total - s.step - CASE WHEN s.call_no % 17 = 0 THEN t.total ELSE 0 END AS remaining,
  s.step / t.total * 100 + CASE WHEN s.call_no % 19 = 0 THEN 10 ELSE 0 END AS pct, (s.step = t.total) <> ((s.call_no + s.session_id) % 23 = 0) AS done, total_cost / t.total * (t.total - s.step) AS cost,
  coalesce(e.n, 0) AS n_events, coalesce(e.reached, false) AS reached, coalesce(e.cancelled, false) AS cancelled
  FROM steps s JOIN rep t ON t.route_id = s.session_id AND t.step = s.step LEFT JOIN ends e ON e.session_id = s.session_id AND e.call_no = s.call_no),
evf AS (SELECT 'unsupported_type' AS check_name, session_id, call_no, place FROM evs WHERE rank = 0 UNION ALL SELECT 'duplicate_type', session_id, call_no, place FROM evs WHERE nth > 1 UNION ALL SELECT 'order', session_id, call_no, place FROM evs WHERE before > rank
  UNION ALL SELECT 'other_session', session_id, call_no, place FROM evs WHERE event_session <> session_id UNION ALL SELECT 'other_route', session_id, call_no, place FROM evs WHERE event_route IS NULL),
lists AS (SELECT q.route_id, q.step, list_prepend(r.origin, coalesce(list(g.target ORDER BY g.sequence) FILTER (g.target IS NOT NULL), [])) AS v FROM rep q JOIN f_routes r ON r.route_id = q.route_id LEFT JOIN f_segments g ON g.route_id = q.route_id AND g.sequence <= q.step GROUP BY q.route_id, q.step, r.origin),
seen AS (SELECT h.*, v AS wanted, CASE h.call_no % 7 WHEN 3 THEN v[:-2] WHEN 4 THEN list_append(v, v[1]) WHEN 5 THEN list_reverse(v) WHEN 6 THEN NULL ELSE v END AS visited, cost * CASE WHEN (h.call_no + h.session_id) % 29 = 0 THEN -1 ELSE 1 END + CASE WHEN h.call_no % 23 = 0 THEN 3 ELSE 0 END AS distance
  FROM shot h JOIN lists l ON l.route_id = h.session_id AND l.step = h.step)"""

_SESSION_FAULTS = f"""{_TOLD},
sess AS (SELECT session_id, call_no, unnest([CASE WHEN state <> 'ACTIVE' THEN 'state' END, CASE WHEN node IS NULL THEN 'no_node' END, CASE WHEN step = 0 THEN 'no_segment' END, CASE WHEN remaining < 0 THEN 'remaining_segments' END,
    CASE WHEN done AND remaining > 0 THEN 'completed_with_segments' END, CASE WHEN done AND cost > 1e-9 THEN 'completed_with_cost' END, CASE WHEN pct > 100 THEN 'percentage_range' END,
    CASE WHEN pct <= 100 AND done AND abs(pct - 100) >= 1e-9 THEN 'completed_below_100' END, CASE WHEN pct <= 100 AND NOT done AND abs(pct - 100) < 1e-9 THEN 'full_not_completed' END,
    CASE WHEN visited IS NULL OR len(visited) = 0 THEN 'visited_missing' END, CASE WHEN len(list_distinct(visited)) < len(visited) THEN 'visited_duplicates' END, CASE WHEN len(visited) > 0 AND visited[-1] IS DISTINCT FROM node THEN 'visited_end' END,
    CASE WHEN len(visited) > 0 AND visited <> wanted THEN 'visited_wrong' END, CASE WHEN distance < 0 THEN 'remaining_distance' END, CASE WHEN done AND distance > 1e-9 THEN 'completed_with_distance' END]) AS check_name FROM seen),
found AS (SELECT check_name, session_id, call_no, cast(NULL AS bigint) AS place FROM sess WHERE check_name IS NOT NULL UNION ALL SELECT check_name, session_id, call_no, place FROM evf
  UNION ALL SELECT 'destination_not_completed', session_id, call_no, NULL FROM shot WHERE reached AND NOT done UNION ALL SELECT 'cancelled_state', session_id, call_no, NULL FROM shot WHERE cancelled AND state <> 'CANCELLED')"""


def _shots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots of all calls, into which some calls bring wrong states, nodes, remainders, percentages and ends."""
    n, total = F.col("call_no"), F.col("step") + F.col("remaining_segments")
    shots = _snapshots(spark, sf_dir).withColumn("total", total)
    return shots.withColumns(
        {
            "session": F.col("session_id"),
            "route": F.col("session_id"),
            "node": F.col("current_node"),
            "state": F.when(n % 11 == 0, "CANCELLED").otherwise("ACTIVE"),
            "current_node": F.when(n % 13 > 0, F.col("current_node")),
            "remaining_segments": F.col("remaining_segments") - F.when(n % 17 == 0, F.col("total")).otherwise(0),
            "percentage": F.col("percentage") + F.when(n % 19 == 0, 10).otherwise(0),
            "completed": F.col("completed") != ((n + F.col("session_id")) % 23 == 0),
        }
    )


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, at, own = F.col("call_no"), F.col("place"), F.col("session_id")
    named = {"event_session": F.when((n % 3 == 0) & (at == 1), own + 1).otherwise(own), "event_route": F.when((n % 5 == 0) & (at == 0), None).otherwise(own)}
    return _faulty_batches(spark, sf_dir)[0].withColumns(named)


def _base(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(snapshots, events) as tables, as audits and reports read them more than once."""
    return written(_shots(spark, sf_dir), "shots"), written(_events(spark, sf_dir), "events")


def _session_shots(spark: SparkSession, sf_dir: str, shots: DataFrame) -> DataFrame:
    """Snapshots with the nodes that they say were visited, some of them cut, repeated, turned round or missing."""
    segments, routes, n = called(spark, sf_dir, "f_segments"), called(spark, sf_dir, "f_routes"), F.col("call_no")
    # a route has a few segments
    targets = segments.groupBy(F.col("route_id").alias("route")).agg(F.transform(F.array_sort(F.collect_list(F.struct("sequence", "target"))), lambda s: s["target"]).alias("targets"))
    told = shots.join(reports.sorting(targets), "route").join(reports.sorting(routes.select(F.col("route_id").alias("route"), "origin")), "route")
    v = F.slice(F.concat(F.array("origin"), "targets"), 1, F.col("step").cast("int") + 1)
    told = told.withColumn("v", v)
    visited = F.when(n % 7 == 3, F.slice("v", 1, F.size("v") - 1)).when(n % 7 == 4, F.concat("v", F.array("origin"))).when(n % 7 == 5, F.reverse("v")).when(n % 7 == 6, None).otherwise(F.col("v"))
    distance = F.col("remaining_cost") * F.when((n + F.col("session_id")) % 29 == 0, -1).otherwise(1) + F.when(n % 23 == 0, 3).otherwise(0)
    return told.withColumns({"visited": visited, "remaining_distance": distance})


def _session_faults(spark: SparkSession, sf_dir: str, shots: DataFrame, events: DataFrame) -> DataFrame:
    prefixes = reports.visited_prefixes(called(spark, sf_dir, "f_segments"), called(spark, sf_dir, "f_routes"))
    return reports.session_audit(_session_shots(spark, sf_dir, shots), prefixes, events, *_BY)


@register(oracle(f"WITH {_SESSION_FAULTS} SELECT check_name, session_id, call_no, cast(place AS bigint) AS place FROM found"))
def session_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rules the snapshots of all sessions break, with their visited nodes, distances and events."""
    return _session_faults(spark, sf_dir, *_base(spark, sf_dir))


def _statistics(shots: DataFrame, events: DataFrame) -> DataFrame:
    """What a report tells of each snapshot beside its faults."""
    n = events.groupBy(*_BY).agg(F.count(F.lit(1)).alias("n"))
    told = shots.join(reports.sorting(n), list(_BY), "left")
    return told.select(*_BY, F.coalesce("n", F.lit(0)).alias("n_events"), F.round("percentage", 6).alias("percentage"), "remaining_segments", "completed")


_REPORT = "SELECT h.session_id, h.call_no, h.n_events, round(pct, 6) AS percentage, remaining AS remaining_segments, done AS completed, coalesce(k.n, 0) = 0 AS valid, coalesce(k.n, 0) AS n_errors"
_COUNTED = "LEFT JOIN (SELECT session_id, call_no, count(*) AS n FROM found GROUP BY session_id, call_no) k ON k.session_id = h.session_id AND k.call_no = h.call_no"


@register(oracle(f"WITH {_SESSION_FAULTS} {_REPORT} FROM shot h {_COUNTED}"))
def session_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each session's snapshot: whether it is valid, its number of faults and of events, and how far it is."""
    base = _base(spark, sf_dir)
    return reports.reports(_session_faults(spark, sf_dir, *base), _statistics(*base), *_BY).drop("n_warnings")


_PLACED = f"""{_TOLD},
pos AS (SELECT h.*, c.event_id, CASE WHEN c.event_id % 31 > 0 THEN 'simulator' END AS provider, CASE WHEN c.event_id % 37 = 0 THEN 'no route' END AS error, c.event_id % 43 > 0 AS given, p.graph_id, p.source, p.x, p.y, p.recorded_at,
    CASE WHEN h.call_no % 17 > 0 THEN t.node END AS nearest, h.step > 0 AS on_way, c.event_id % 41 = 0 AS unnamed, CASE WHEN c.event_id % 47 = 0 THEN 0 ELSE h.step END AS sequence
  FROM shot h JOIN rep t ON t.route_id = h.session_id AND t.step = h.step JOIN f_calls c ON c.session_id = h.session_id AND c.call_no = h.call_no JOIN f_raw_positions p ON p.event_id = c.event_id),
rated AS (SELECT *, on_way AND unnamed AS malformed, on_way AND NOT unnamed AND sequence < 1 AS misplaced, abs(pct - 100) < 1e-9 AS is_full, CASE WHEN NOT (on_way AND (unnamed OR sequence < 1)) THEN CASE WHEN on_way THEN sequence ELSE 0 END + remaining END AS reckoned FROM pos),
checks AS (SELECT session_id, call_no, unnest(CASE WHEN error IS NOT NULL THEN ['runtime_error'] ELSE [CASE WHEN provider IS NULL THEN 'no_provider' END, CASE WHEN NOT given THEN 'no_position' END, CASE WHEN given AND graph_id IS NULL THEN 'missing_graph_id' END,
    CASE WHEN given AND source IS NULL THEN 'missing_source' END, CASE WHEN given AND x IS NULL AND y IS NULL THEN 'missing_coordinates' END, CASE WHEN given AND recorded_at IS NULL THEN 'missing_recorded_at' END, CASE WHEN nearest IS NULL THEN 'no_nearest_node' END,
    CASE WHEN malformed THEN 'malformed_segment' END, CASE WHEN misplaced THEN 'foreign_segment' END, CASE WHEN nearest IS NOT NULL AND nearest IS DISTINCT FROM node THEN 'other_node' END, CASE WHEN done AND NOT is_full THEN 'completed_below_100' END,
    CASE WHEN NOT done AND is_full THEN 'full_not_completed' END, CASE WHEN reckoned > 0 AND abs(CASE WHEN on_way THEN sequence ELSE 0 END / reckoned * 100 - pct) > 1e-9 THEN 'step_percentage' END, CASE WHEN pct > 100 THEN 'percentage_range' END,
    CASE WHEN remaining < 0 THEN 'remaining_segments' END] END) AS check_name FROM rated),
found AS (SELECT check_name, session_id, call_no, cast(NULL AS bigint) AS place FROM checks WHERE check_name IS NOT NULL
  UNION ALL SELECT e.check_name, e.session_id, e.call_no, e.place FROM evf e JOIN pos p ON p.session_id = e.session_id AND p.call_no = e.call_no WHERE error IS NULL
  UNION ALL SELECT 'destination_not_completed', session_id, call_no, NULL FROM pos WHERE error IS NULL AND reached AND NOT done UNION ALL SELECT 'completed_without_destination', session_id, call_no, NULL FROM pos WHERE error IS NULL AND done AND NOT reached)"""


def _position_shots(spark: SparkSession, sf_dir: str, shots: DataFrame) -> DataFrame:
    """Snapshots with provider, reading, nearest node and segment, some of them missing or wrong."""
    e, n, calls, readings = F.col("event_id"), F.col("call_no"), view(spark, sf_dir, "f_calls"), view(spark, sf_dir, "f_raw_positions")
    told = shots.join(reports.sorting(calls.select(*_BY, "event_id")), list(_BY)).join(reports.sorting(readings), "event_id")
    step = F.col("step")
    segment = F.struct(F.when(e % 41 > 0, step.cast("string")).alias("id"), F.lit("from").alias("source"), F.col("node").alias("target"), F.when(e % 47 == 0, 0).otherwise(step).alias("sequence"))
    return told.withColumns(
        {
            "provider": F.when(e % 31 > 0, "simulator"),
            "error": F.when(e % 37 == 0, "no route"),
            "position": F.when(e % 43 > 0, F.struct("graph_id", "source", "x", "y", "recorded_at")),
            "nearest_node": F.when(n % 17 > 0, F.col("node")),
            "segment": F.when(step > 0, segment),
        }
    )


def _position_faults(spark: SparkSession, sf_dir: str, shots: DataFrame, events: DataFrame) -> DataFrame:
    return reports.position_audit(_position_shots(spark, sf_dir, shots), events, *_BY)


@register(oracle(f"WITH {_PLACED} SELECT check_name, session_id, call_no, cast(place AS bigint) AS place FROM found"))
def position_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which rules the snapshots that follow positions break, with their providers, segments and events."""
    return _position_faults(spark, sf_dir, *_base(spark, sf_dir))


@register(oracle(f"WITH {_PLACED} {_REPORT} FROM shot h {_COUNTED}"))
def position_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each snapshot that follows a position."""
    base = _base(spark, sf_dir)
    return reports.reports(_position_faults(spark, sf_dir, *base), _statistics(*base), *_BY).drop("n_warnings")


@register(
    oracle(
        f"""WITH {_OFFERED}, faults AS ({_OFFER_FAULTS})
SELECT o.request_id, coalesce(f.n, 0) = 0 AS valid, coalesce(f.n, 0) AS n_errors, count_if(b.route_id IS NULL) AS n_routes, count_if(b.route_id IS NOT NULL) AS n_failed, count(DISTINCT coalesce(preference, '')) AS n_preferences, round(avg(total_cost), 6) AS avg_cost, round(avg(hop_count), 6) AS avg_hops
FROM f_offers o LEFT JOIN (SELECT DISTINCT route_id FROM faults WHERE route_id IS NOT NULL) b ON b.route_id = o.route_id LEFT JOIN (SELECT request_id, count(*) AS n FROM faults GROUP BY request_id) f ON f.request_id = o.request_id GROUP BY o.request_id, f.n"""
    )
)
def routing_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the routes offered in reply to each request: faults, sound and failed routes, preferences, mean cost and hops."""
    routes, stops, asked, contexts, links = (view(spark, sf_dir, n) for n in ("f_offers", "f_stops", "f_asked", "f_contexts", "f_links"))
    found = reports.routing_reports(audits.routing_audit(routes, stops, asked, contexts, links, _policy()), routes)
    return found.withColumns({c: F.round(c, 6) for c in ("avg_cost", "avg_hops")})


_WRITTEN = """wr AS (SELECT c_custkey AS ord, c_nationkey AS batch_id, CASE WHEN c_custkey % 17 = 0 THEN c_custkey - 1 ELSE c_custkey END AS uso_id, CASE WHEN c_custkey % 19 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS model_id,
  CASE c_custkey % 2 WHEN 0 THEN 'candidateWalls' ELSE 'candidateOpenings' END AS collection, CASE WHEN c_custkey % 23 = 0 THEN 0 ELSE c_custkey END AS candidate_id, CASE WHEN c_custkey % 29 > 0 THEN concat('el-', cast(c_custkey AS string)) ELSE '' END AS reference,
  CASE c_custkey % 31 WHEN 0 THEN NULL WHEN 1 THEN 'DRAFT' WHEN 2 THEN 'PUBLISHED' ELSE 'GENERATED' END AS status FROM customer)"""
_KNOWN = "kn AS (SELECT c_nationkey AS model_id, CASE c_custkey % 2 WHEN 0 THEN 'candidateWalls' ELSE 'candidateOpenings' END AS collection, c_custkey AS candidate_id FROM customer WHERE c_custkey % 37 > 0)"
_RELATED = """rl AS (SELECT o_orderkey AS ord, c_nationkey AS batch_id, o_custkey AS src, CASE WHEN o_orderkey % 41 = 0 THEN o_custkey ELSE o_custkey + 25 * (o_orderkey % 3) END AS dst,
  CASE o_orderkey % 11 WHEN 0 THEN 'NEAR' WHEN 1 THEN 'WITHIN' WHEN 2 THEN 'CONTAINS' WHEN 3 THEN NULL ELSE 'TOUCHES' END AS relation FROM orders JOIN customer ON c_custkey = o_custkey)"""


def _table(spark: SparkSession, sf_dir: str, common: str) -> DataFrame:
    """Rows of a common table's text over the given tables."""
    name, text = common.split(" AS (", 1)
    for table in ("customer", "orders"):
        view(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(f"WITH {name} AS ({text} SELECT * FROM {name}")


@register(
    oracle(
        f"""WITH {_WRITTEN}, {_KNOWN}, {_RELATED}, ok AS (SELECT *, row_number() OVER (PARTITION BY batch_id, uso_id ORDER BY ord) AS nu, row_number() OVER (PARTITION BY batch_id, candidate_id ORDER BY ord) AS nc FROM wr WHERE model_id = batch_id)
SELECT 'orphan_object' AS check_name, batch_id, ord AS key FROM wr WHERE model_id <> batch_id UNION ALL SELECT 'duplicate_object', batch_id, ord FROM ok WHERE nu > 1 UNION ALL SELECT 'duplicate_candidate', batch_id, ord FROM ok WHERE nc > 1
UNION ALL SELECT 'missing_reference', batch_id, ord FROM ok WHERE reference = '' UNION ALL SELECT 'missing_candidate', batch_id, ord FROM ok WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.model_id = ok.batch_id AND kn.collection = ok.collection AND kn.candidate_id = ok.candidate_id)
UNION ALL SELECT 'invalid_status', batch_id, ord FROM ok WHERE status IS NULL OR status = 'DRAFT' UNION ALL SELECT 'self_relation', batch_id, ord FROM rl WHERE src = dst UNION ALL SELECT 'unknown_type', batch_id, ord FROM rl WHERE relation IS NULL OR relation = 'NEAR'
UNION ALL SELECT 'orphan_relation', batch_id, ord FROM rl WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.batch_id = rl.batch_id AND ok.uso_id = rl.src) OR NOT EXISTS (SELECT 1 FROM ok WHERE ok.batch_id = rl.batch_id AND ok.uso_id = rl.dst)"""
    )
)
def production_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the objects and relationships written for each nation's batch."""
    return reports.production_audit(*(_table(spark, sf_dir, t) for t in (_WRITTEN, _KNOWN, _RELATED)))


_LIVES = "lv AS (SELECT c_custkey AS uso_id, CASE WHEN c_custkey % 13 = 0 THEN 'PUBLISHED' WHEN c_custkey % 29 = 0 THEN NULL ELSE 'GENERATED' END AS status FROM customer)"
_WANTED = "wt AS (SELECT o_custkey AS uso_id, o_orderkey AS ord, CASE o_orderkey % 5 WHEN 0 THEN 'PUBLISHED' WHEN 1 THEN 'DEPRECATED' WHEN 2 THEN 'GENERATED' ELSE 'VALIDATED' END AS wanted FROM orders)"


@register(
    oracle(
        f"""WITH RECURSIVE {_LIVES}, {_WANTED}, ask AS (SELECT w.*, l.status, row_number() OVER (PARTITION BY w.uso_id ORDER BY ord, wanted) AS nth FROM wt w LEFT JOIN lv l ON l.uso_id = w.uso_id),
go AS (SELECT uso_id, ord, wanted, nth, status AS before, coalesce((status = 'GENERATED' AND wanted = 'VALIDATED') OR (status = 'VALIDATED' AND wanted = 'PUBLISHED') OR (status = 'PUBLISHED' AND wanted = 'DEPRECATED'), false) AS accepted FROM ask WHERE nth = 1
  UNION ALL SELECT a.uso_id, a.ord, a.wanted, a.nth, CASE WHEN g.accepted THEN g.wanted ELSE g.before END, coalesce((CASE WHEN g.accepted THEN g.wanted ELSE g.before END = 'GENERATED' AND a.wanted = 'VALIDATED') OR (CASE WHEN g.accepted THEN g.wanted ELSE g.before END = 'VALIDATED' AND a.wanted = 'PUBLISHED')
    OR (CASE WHEN g.accepted THEN g.wanted ELSE g.before END = 'PUBLISHED' AND a.wanted = 'DEPRECATED'), false) FROM go g JOIN ask a ON a.uso_id = g.uso_id AND a.nth = g.nth + 1)
SELECT uso_id, ord, wanted, before, accepted FROM go"""
    )
)
def status_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of status asked for by all orders, with the status before each and whether it is accepted."""
    return reports.status_changes(_table(spark, sf_dir, _WANTED), _table(spark, sf_dir, _LIVES))


_MODELLED = """md AS (SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 7 = 0 THEN -o_custkey ELSE o_custkey END AS uso_id, CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'ROOM' END AS semantic_category,
  CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN 'generated' WHEN 2 THEN 'DEPRECATED' ELSE 'GENERATED' END AS lifecycle, CASE o_orderkey % 13 WHEN 0 THEN NULL WHEN 1 THEN cast(-0.5 AS double) WHEN 2 THEN cast(1.5 AS double) WHEN 3 THEN cast(0 AS double) WHEN 4 THEN cast('NaN' AS double) ELSE cast(1 AS double) END AS confidence FROM orders)"""


@register(
    oracle(
        f"""WITH {_MODELLED}, q AS (SELECT *, uso_id IN (SELECT c_custkey FROM customer) AS there, row_number() OVER (PARTITION BY uso_id ORDER BY ord) AS nth FROM md)
SELECT 'orphan' AS check_name, ord, uso_id FROM q WHERE NOT there UNION ALL SELECT 'duplicate', ord, uso_id FROM q WHERE there AND nth > 1 UNION ALL SELECT 'invalid_lifecycle', ord, uso_id FROM q WHERE there AND (lifecycle IS NULL OR lifecycle = 'generated')
UNION ALL SELECT 'confidence_range', ord, uso_id FROM q WHERE there AND (confidence IS NULL OR isnan(confidence) OR confidence < 0 OR confidence > 1) UNION ALL SELECT 'no_confidence', ord, uso_id FROM q WHERE there AND semantic_category = 'ROOM' AND confidence = 0"""
    )
)
def semantic_production(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the semantic models that were written, lifecycle and confidence among it."""
    return reports.semantic_production_audit(view(spark, sf_dir, "f_objects"), _table(spark, sf_dir, _MODELLED))


_SCOPES = "sc AS (SELECT DISTINCT c_nationkey AS graph_id FROM customer)"
_MEANT = "me AS (SELECT c_nationkey AS graph_id, c_custkey AS model_id, CASE WHEN c_custkey % 23 > 0 THEN c_custkey END AS uso_id FROM customer WHERE c_nationkey % 10 > 0)"
_DETECTED = """de AS (SELECT o_orderkey AS ord, c_nationkey AS graph_id, o_custkey AS model_id, CASE o_orderkey % 19 WHEN 0 THEN 'STAIRS' WHEN 1 THEN NULL WHEN 2 THEN 'ROOM_ENTRY' WHEN 3 THEN 'BUILDING_ENTRY' WHEN 4 THEN 'VERTICAL_CONNECTOR' WHEN 5 THEN 'CORRIDOR_INTERSECTION' ELSE 'DEAD_END' END AS candidate_type
  FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey % 7 > 0)"""
_DETECTION_FAULTS = f"""{_SCOPES}, {_MEANT}, {_DETECTED}, found AS (SELECT 'missing_object' AS check_name, graph_id, model_id AS key FROM me WHERE uso_id IS NULL UNION ALL SELECT 'unknown_type', graph_id, ord FROM de WHERE candidate_type IS NULL OR candidate_type = 'STAIRS'
  UNION ALL SELECT 'duplicate_detection', graph_id, ord FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, model_id ORDER BY ord) AS n FROM de) t WHERE n > 1
  UNION ALL SELECT 'no_models', graph_id, NULL FROM sc WHERE graph_id NOT IN (SELECT graph_id FROM me) UNION ALL SELECT 'no_detections', graph_id, NULL FROM sc WHERE graph_id NOT IN (SELECT graph_id FROM de))"""


def _detection_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.detection_audit(*(_table(spark, sf_dir, t) for t in (_SCOPES, _MEANT, _DETECTED)))


@register(oracle(f"WITH {_DETECTION_FAULTS} SELECT check_name, graph_id, cast(key AS bigint) AS key FROM found"))
def detection_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with the models that candidates are detected in, and with the candidates."""
    return _detection_faults(spark, sf_dir)


@register(
    oracle(
        f"""WITH {_DETECTION_FAULTS} SELECT s.graph_id, count_if(check_name NOT LIKE 'no%') = 0 AS valid, count_if(check_name NOT LIKE 'no%') AS n_errors, count_if(check_name LIKE 'no%') AS n_warnings
FROM sc s LEFT JOIN found f ON f.graph_id = s.graph_id GROUP BY s.graph_id"""
    )
)
def detection_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of each graph's detection: errors and warnings."""
    return reports.reports(_detection_faults(spark, sf_dir), _table(spark, sf_dir, _SCOPES), "graph_id", warnings=reports.WARNINGS)


def _written(kind: Column) -> Column:
    """Shapes as JSON geometries, of which some are cut short, of unknown types, or hold texts for numbers."""
    at = lambda x, y: F.concat(F.lit('{"x":'), F.expr(x).cast("string"), F.lit(',"y":'), F.expr(y).cast("string"), F.lit("}"))
    quoted = F.concat(F.lit('{"x":"'), F.col("x").cast("string"), F.lit('","y":1}'))
    ring = F.concat_ws(",", at("x", "y"), at("x + w", "y"), at("x + w", "y + h"))
    n = F.col("ord") % 12
    inner = (
        F.when(kind == "Point", F.when(n == 1, quoted).when(n == 2, F.lit("[1, 2]")).when(n == 3, F.lit("null")).otherwise(at("x", "y")))
        .when(kind == "Line", F.concat(F.lit("["), F.when(n == 4, at("x", "y")).when(n == 5, F.concat(at("x", "y"), F.lit(",null"))).otherwise(F.concat_ws(",", at("x", "y"), at("x2", "y2"))), F.lit("]")))
        .otherwise(F.concat(F.lit("["), F.when(n == 6, at("x", "y")).when(n == 7, F.concat(ring, F.lit(","), quoted)).otherwise(ring), F.lit("]")))
    )
    told = F.when(n == 8, "Circle").otherwise(kind)
    return F.when(n == 9, None).when(n == 10, F.lit("{")).when(n == 11, F.lit("7")).otherwise(F.concat(F.lit('{"type":"'), told, F.lit('","coordinates":'), inner, F.lit("}")))


@register(
    oracle(
        """SELECT import_id, id, CASE WHEN ord % 12 > 8 THEN 'missing' WHEN ord % 12 = 8 THEN 'type' WHEN type = 'circle' AND ord % 12 IN (1, 2, 3) THEN 'point' WHEN type = 'line' AND ord % 12 IN (4, 5) THEN 'points' WHEN type = 'rect' AND ord % 12 IN (6, 7) THEN 'points' END AS reason FROM f_prims"""
    )
)
def geometry_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why the geometries written for all shapes are refused; null for those that are taken."""
    kind = F.when(F.col("type") == "line", "Line").when(F.col("type") == "circle", "Point").otherwise("Polygon")
    return view(spark, sf_dir, "f_prims").select("import_id", "id", geometry.geometry_reason(_written(kind)).alias("reason"))


@register(oracle("SELECT import_id, id, cast(4 AS int) AS n_points, x AS last_x, y + h AS last_y FROM f_prims WHERE type = 'rect'"))
def geojson_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rects written as GeoJSON polygons and read back as open rings."""
    at = lambda x, y: F.concat(F.lit("["), F.expr(x).cast("string"), F.lit(","), F.expr(y).cast("string"), F.lit("]"))
    ring = F.concat_ws(",", at("x", "y"), at("x + w", "y"), at("x + w", "y + h"), at("x", "y + h"), at("x", "y"))
    points = geometry.geojson_shape(F.concat(F.lit('{"type":"Polygon","coordinates":[['), ring, F.lit("]]}")))[1]
    rows = view(spark, sf_dir, "f_prims").where("type = 'rect'").select("import_id", "id", points.alias("p"))
    # a rect without an extent has a corner in common with the first one
    last = F.element_at("p", -1)
    return rows.select("import_id", "id", F.size("p").alias("n_points"), last["x"].alias("last_x"), last["y"].alias("last_y"))


@register(
    oracle(
        """SELECT import_id, CASE WHEN import_id % 5 = 3 THEN 'FAILED' ELSE 'NORMALIZED' END AS status, CASE WHEN import_id % 5 <> 3 THEN cast(0 AS double) END AS origin_x, CASE WHEN import_id % 5 <> 3 THEN 'mm' END AS units, CASE WHEN import_id % 5 <> 3 THEN CASE WHEN import_id % 7 = 1 THEN 12.5 ELSE 500 END END AS max_x,
  CASE WHEN import_id % 5 <> 3 THEN coalesce(list_aggregate(list_distinct(list(layer)).list_sort(), 'string_agg', ','), '') END AS layers, CASE WHEN import_id % 5 <> 3 THEN string_agg(concat(id, ':', type), ',' ORDER BY layer NULLS LAST, ord) END AS elements,
  CASE WHEN import_id % 5 <> 3 THEN coalesce(string_agg(CASE WHEN layer IS NOT NULL THEN concat(layer, '>', id) END, ',' ORDER BY layer NULLS LAST, ord), '') END AS relationships FROM f_prims GROUP BY import_id"""
    )
)
def canonical_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole model of every document: coordinate system, bounds, layers, elements in order and what each layer contains."""
    found = svg.canonical_models(documents(view(spark, sf_dir, "f_prims")))
    joined = lambda c, f: F.array_join(F.transform(c, f), ",")
    return found.select(
        "import_id", "status", F.col("coordinate_system.origin.x").alias("origin_x"), F.col("coordinate_system.units").alias("units"), F.col("bounds.max_x").alias("max_x"), F.array_join("layers", ",").alias("layers"),
        joined("elements", lambda e: F.concat(e["id"], F.lit(":"), e["type"])).alias("elements"), joined("relationships", lambda r: F.concat(r["from"], F.lit(">"), r["to"])).alias("relationships"),
    )
