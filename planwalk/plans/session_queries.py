"""Queries over sessions and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwalk.functions import geometry
from planwalk.operators import positioning, sessions, tables
from planwalk.plans.views import oracle, view
from planwalk.registry import register

_NEXT = """CASE WHEN a = 'START' AND s IN ('CREATED', 'READY') THEN 'ACTIVE' WHEN a = 'PAUSE' AND s = 'ACTIVE' THEN 'PAUSED' WHEN a = 'RESUME' AND s = 'PAUSED' THEN 'ACTIVE'
  WHEN a = 'CANCEL' AND s IN ('ACTIVE', 'PAUSED') THEN 'CANCELLED' WHEN a = 'COMPLETE' AND s = 'ACTIVE' THEN 'COMPLETED' ELSE s END"""
_DAYS = "c AS (SELECT session_id, cast(ts AS date) AS day, row_number() OVER (PARTITION BY session_id, cast(ts AS date) ORDER BY call_no) AS n, action FROM f_calls)"
_FSM = f"""{_DAYS},
run AS (SELECT session_id, day, n, action, s AS before, {_NEXT.replace("a =", "action =")} AS state FROM (SELECT *, 'CREATED' AS s FROM c WHERE n = 1) z
  UNION ALL SELECT c.session_id, c.day, c.n, c.action, r.state, {_NEXT.replace("a =", "c.action =").replace("s IN", "r.state IN").replace("s =", "r.state =").replace("ELSE s", "ELSE r.state")}
  FROM run r JOIN c ON c.session_id = r.session_id AND c.day = r.day AND c.n = r.n + 1)"""
_TOTALS = "tot AS (SELECT route_id, count(*) AS total FROM f_segments GROUP BY route_id)"
_STEPS = f"{_TOTALS}, steps AS (SELECT c.session_id, c.call_no, least(c.call_no - 1, total) AS step FROM f_calls c JOIN tot ON route_id = c.session_id)"
_REPORTS = """rep AS (SELECT s.route_id, cast(s.sequence AS bigint) AS step, s.target AS node, t.total, r.total_cost FROM f_segments s JOIN tot t ON t.route_id = s.route_id JOIN f_routes r ON r.route_id = s.route_id
  UNION ALL SELECT t.route_id, 0, r.origin, t.total, r.total_cost FROM tot t JOIN f_routes r ON r.route_id = t.route_id)"""
_EVENTS = f"""{_STEPS}, {_REPORTS},
told AS (SELECT st.session_id, st.call_no, unnest(list_filter([
    struct_pack(p := 0, e := 'SessionStarted'), CASE WHEN st.step > 0 THEN struct_pack(p := 1, e := 'SegmentEntered') END, CASE WHEN st.step > 0 THEN struct_pack(p := 2, e := 'SegmentCompleted') END,
    CASE WHEN st.step > 0 THEN struct_pack(p := 3, e := 'NodeReached') END, CASE WHEN st.step = total THEN struct_pack(p := 4, e := 'DestinationReached') END], lambda x: x IS NOT NULL)) AS v, node
  FROM steps st JOIN rep ON rep.route_id = st.session_id AND rep.step = st.step)"""


def _by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "f_calls").withColumn("day", F.col("ts").cast("date"))


@register(oracle(f"WITH {_FSM} SELECT session_id, day, arg_max(state, n) AS state FROM run GROUP BY session_id, day"))
def session_fsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final state of each session's day of calls."""
    return sessions.fold(_by_day(spark, sf_dir), "session_id", "day").select("session_id", "day", "state")


@register(oracle(f"WITH {_FSM} SELECT session_id, day, count_if(state <> before) AS n_accepted, count_if(state = before) AS n_rejected FROM run GROUP BY session_id, day"))
def rejected_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and rejected actions of each session's day."""
    return sessions.fold(_by_day(spark, sf_dir), "session_id", "day").select("session_id", "day", "n_accepted", "n_rejected")


def called(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Rows of a view by route_id whose route has calls."""
    return view(spark, sf_dir, name).join(view(spark, sf_dir, "f_calls").select(F.col("session_id").alias("route_id")).distinct(), "route_id", "left_semi")


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = sessions.totals(called(spark, sf_dir, "f_segments")).withColumnRenamed("route_id", "session_id")
    return sessions.walk_steps(view(spark, sf_dir, "f_calls"), totals)


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.progress(view(spark, sf_dir, "f_segments"), view(spark, sf_dir, "f_routes"))


def _called_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """_reports of the routes that have calls."""
    return sessions.progress(called(spark, sf_dir, "f_segments"), called(spark, sf_dir, "f_routes"))


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).join(_called_reports(spark, sf_dir).withColumnRenamed("route_id", "session_id"), ["session_id", "step"])


@register(oracle(f"WITH {_STEPS} SELECT session_id, call_no, step FROM steps"))
def walk_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment that each call finds its session on."""
    return _steps(spark, sf_dir)


@register(
    oracle(
        f"""WITH {_TOTALS}, {_REPORTS} SELECT route_id, step, total - step AS remaining_segments, round(total_cost / total * (total - step), 6) AS remaining_cost,
  round(step / total * 100, 6) AS percentage, step = total AS completed FROM rep"""
    )
)
def route_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Progress at every step of every route."""
    rounded = {c: F.round(c, 6) for c in ("remaining_cost", "percentage")}
    return _reports(spark, sf_dir).withColumns(rounded).select("route_id", "step", "remaining_segments", "remaining_cost", "percentage", "completed")


@register(oracle("SELECT cast(NULL AS varchar) AS check_name, route_id, cast(sequence AS bigint) AS step FROM f_segments WHERE false"))
def progress_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of all progress reports; no row is expected."""
    return sessions.progress_audit(_reports(spark, sf_dir), sessions.totals(view(spark, sf_dir, "f_segments")))


@register(oracle("SELECT route_id, sequence, concat('O', cast(route_id AS varchar), '>', string_agg(target, '>') OVER (PARTITION BY route_id ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS visited FROM f_segments"))
def visited_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes visited by the end of every segment."""
    return sessions.visited(view(spark, sf_dir, "f_segments"), view(spark, sf_dir, "f_routes"))


@register(oracle(f"WITH {_EVENTS} SELECT session_id, call_no, cast(row_number() OVER (PARTITION BY session_id, call_no ORDER BY v.p) - 1 AS bigint) AS place, v.e AS event_type, CASE WHEN v.e IN ('NodeReached', 'DestinationReached') THEN node END AS node FROM told"))
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of every call."""
    return sessions.session_events(_steps(spark, sf_dir), _reports(spark, sf_dir))


@register(oracle(f"WITH {_EVENTS} SELECT session_id, v.e AS event_type, count(*) AS n FROM told GROUP BY session_id, v.e"))
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each type per session."""
    return sessions.event_counts(sessions.session_events(_steps(spark, sf_dir), _reports(spark, sf_dir)), "session_id")


_TYPED = """ev AS (SELECT session_id, call_no AS place, CASE action WHEN 'START' THEN 'SessionStarted' WHEN 'PAUSE' THEN 'SegmentEntered' WHEN 'RESUME' THEN 'NodeReached' WHEN 'CANCEL' THEN 'SessionCancelled' ELSE 'DestinationReached' END AS event_type FROM f_calls),
m AS (SELECT *, list_position(['SessionStarted', 'SegmentEntered', 'SegmentCompleted', 'NodeReached', 'FloorChanged', 'DestinationReached', 'SessionCancelled'], event_type) AS rank,
  row_number() OVER (PARTITION BY session_id, event_type ORDER BY place) AS nth FROM ev),
o AS (SELECT *, lag(rank) OVER (PARTITION BY session_id ORDER BY place) AS before FROM m)"""


@register(oracle(f"WITH {_TYPED} SELECT 'duplicate' AS check_name, session_id, place FROM o WHERE nth > 1 UNION ALL SELECT 'order', session_id, place FROM o WHERE before > rank UNION ALL SELECT 'no_node', session_id, place FROM o WHERE event_type = 'DestinationReached'"))
def event_order_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats and order of calls read as event types."""
    kind = {"START": "SessionStarted", "PAUSE": "SegmentEntered", "RESUME": "NodeReached", "CANCEL": "SessionCancelled"}
    typed = F.lit("DestinationReached")
    for action, event in kind.items():
        typed = F.when(F.col("action") == action, event).otherwise(typed)
    events = view(spark, sf_dir, "f_calls").select("session_id", F.col("call_no").alias("place"), typed.alias("event_type"), F.lit(None).cast("string").alias("node"))
    return sessions.event_audit(events, "session_id")


@register(oracle("SELECT session_id, source, arg_max(event_id, (recorded_at, event_id)) AS event_id, arg_max(x, (recorded_at, event_id)) AS x, arg_max(y, (recorded_at, event_id)) AS y FROM f_positions GROUP BY session_id, source"))
def position_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest reading of each session and source."""
    return positioning.latest(view(spark, sf_dir, "f_positions"), "session_id", "source")


_NEAREST = """near AS (SELECT event_id, session_id, graph_id, node_id, d FROM (SELECT p.event_id, p.session_id, p.graph_id, n.node_id, sqrt((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y)) AS d,
  row_number() OVER (PARTITION BY p.event_id ORDER BY sqrt((p.x - n.x) * (p.x - n.x) + (p.y - n.y) * (p.y - n.y)), n.ord) AS rn
  FROM f_positions p JOIN f_nodes n ON n.graph_id = p.graph_id WHERE n.x IS NOT NULL AND n.y IS NOT NULL) t WHERE rn = 1)"""


@register(oracle(f"WITH {_NEAREST} SELECT event_id, node_id, round(d, 6) AS distance FROM near"))
def nearest_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest node of every reading in its graph."""
    found = positioning.nearest_node(view(spark, sf_dir, "f_positions"), view(spark, sf_dir, "f_nodes"))
    return found.select("event_id", "node_id", F.round("distance", 6).alias("distance"))


_HASH = "abs(list_reduce(list_transform(string_split({0}, ''), lambda c: ord(c)::bigint), lambda h, c: xor(((h * 31 + c) & 4294967295::bigint), 2147483648::bigint) - 2147483648::bigint, 0::bigint))"


@register(oracle(f"SELECT graph_id, node_id, h % 100 AS x, (h // 100) % 100 AS y FROM (SELECT graph_id, node_id, {_HASH.format("graph_id || ':' || node_id")} AS h FROM f_nodes) t"))
def hash_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates hashed from graph and node."""
    x, y = geometry.hash_coordinates(F.concat_ws(":", "graph_id", "node_id"))
    return view(spark, sf_dir, "f_nodes").select("graph_id", "node_id", x.alias("x"), y.alias("y"))


@register(oracle(f"SELECT graph_id, node_id, coalesce(x, cast(h % 100 AS double)) AS x, coalesce(y, cast((h // 100) % 100 AS double)) AS y FROM (SELECT *, {_HASH.format('node_id')} AS h FROM f_nodes) t"))
def node_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node coordinates, hashed where a node has none."""
    return positioning.node_coordinates(view(spark, sf_dir, "f_nodes"))


@register(
    oracle(
        """WITH q AS (SELECT event_id, s.route_id, s.target AS node FROM f_calls c JOIN f_segments s ON s.route_id = c.session_id AND s.sequence = 1 + c.call_no % 7
  UNION ALL SELECT event_id, r.route_id, r.origin FROM f_calls c JOIN f_routes r ON r.route_id = c.session_id),
f AS (SELECT route_id, target, min(sequence) AS step FROM f_segments GROUP BY route_id, target)
SELECT q.event_id, q.node, cast(CASE WHEN q.node = r.origin THEN 0 ELSE f.step END AS bigint) AS step FROM q JOIN f_routes r ON r.route_id = q.route_id LEFT JOIN f ON f.route_id = q.route_id AND f.target = q.node"""
    )
)
def segment_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment of a route that a node stands for."""
    calls, segments, routes = (view(spark, sf_dir, n) for n in ("f_calls", "f_segments", "f_routes"))
    on_way = calls.withColumn("route_id", F.col("session_id")).withColumn("sequence", (1 + F.col("call_no") % 7).cast("int")).join(segments, ["route_id", "sequence"]).select("event_id", "route_id", F.col("target").alias("node"))
    at_start = calls.withColumn("route_id", F.col("session_id")).join(routes, "route_id").select("event_id", "route_id", F.col("origin").alias("node"))
    return positioning.resolve_segment(on_way.unionByName(at_start), segments, routes).select("event_id", "node", "step")


@register(oracle(f"WITH {_STEPS}, {_REPORTS} SELECT s.session_id, s.call_no, s.step, node AS current_node, total - s.step AS remaining_segments, round(s.step / total * 100, 6) AS percentage, s.step = total AS completed FROM steps s JOIN rep ON rep.route_id = s.session_id AND rep.step = s.step"))
def runtime_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every call reports: node, remaining segments, percentage."""
    found = _snapshots(spark, sf_dir).withColumn("percentage", F.round("percentage", 6))
    return found.select("session_id", "call_no", "step", "current_node", "remaining_segments", "percentage", "completed")


@register(oracle("SELECT cast(NULL AS varchar) AS check_name, session_id, call_no FROM f_calls WHERE false"))
def position_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invariants of all snapshots; no row is expected."""
    return positioning.snapshot_audit(_snapshots(spark, sf_dir), sessions.totals(view(spark, sf_dir, "f_segments")))


@register(
    oracle(
        f"""WITH src AS (SELECT DISTINCT graph_id, cast(session_id AS varchar) AS source FROM f_positions),
sim AS (SELECT graph_id, node_id, x, y FROM f_nodes)
SELECT s.graph_id, s.source, coalesce(n.x, cast(h % 100 AS double)) AS x, coalesce(n.y, cast((h // 100) % 100 AS double)) AS y
FROM (SELECT *, {_HASH.format("graph_id || ':' || source")} AS h FROM src) s LEFT JOIN sim n ON n.graph_id = s.graph_id AND n.node_id = 'S' || lpad(s.source, 6, '0')"""
    )
)
def mock_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Provider positions: simulated where a node stands for the source, hashed otherwise."""
    requests = view(spark, sf_dir, "f_positions").select("graph_id", F.col("session_id").cast("string").alias("source")).distinct()
    nodes = view(spark, sf_dir, "f_nodes").select("graph_id", F.col("ord").cast("string").alias("source"), "x", "y")
    return positioning.mock_positions(requests, nodes)


@register(oracle("SELECT date_trunc('hour', recorded_at) AS start, source, count(*) AS n FROM f_positions GROUP BY 1, 2"))
def position_window_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings per source and hour."""
    found = positioning.window_counts(view(spark, sf_dir, "f_positions"))
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@register(oracle("SELECT event_id, source, x, y FROM f_positions WHERE source = 'view' AND graph_id = 'G199603'"))
def filtered_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of one graph and source."""
    return tables.filtered(view(spark, sf_dir, "f_positions"), "event_id", source="view", graph_id="G199603").select("event_id", "source", "x", "y")


@register(oracle("SELECT event_id, source, x, y FROM f_positions WHERE source = 'view'"))
def filtered_list_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of one source in all graphs, in ascending order of event_id."""
    return tables.filtered(view(spark, sf_dir, "f_positions"), "event_id", source="view", graph_id=None).select("event_id", "source", "x", "y")


_FAULTY = f"""{_EVENTS},
base AS (SELECT session_id, call_no, v.p AS p, v.e AS e, node FROM told),
ev AS (SELECT session_id, call_no, CASE WHEN call_no % 13 = 0 THEN 10 - p ELSE p END AS place,
    CASE WHEN call_no % 7 = 0 AND e = 'SegmentEntered' THEN 'SegmentSkipped' WHEN call_no % 11 = 0 AND e = 'NodeReached' THEN 'SegmentCompleted' WHEN call_no % 19 = 0 AND e = 'NodeReached' THEN 'FloorChanged'
      WHEN call_no % 29 = 0 AND e = 'SessionStarted' THEN 'SessionCancelled' ELSE e END AS event_type, CASE WHEN call_no % 31 <> 0 AND e IN ('SegmentEntered', 'SegmentCompleted') THEN p END AS segment, CASE WHEN call_no % 37 <> 0 THEN node END AS node
  FROM base WHERE NOT (call_no % 17 = 0 AND e = 'SegmentEntered')),
m AS (SELECT *, coalesce(list_position(['SessionStarted', 'SegmentEntered', 'SegmentCompleted', 'NodeReached', 'FloorChanged', 'DestinationReached', 'SessionCancelled'], event_type), 0) AS rank,
  row_number() OVER (PARTITION BY session_id, call_no, event_type ORDER BY place) AS nth, row_number() OVER (PARTITION BY session_id, call_no ORDER BY place, event_type) AS pos FROM ev),
o AS (SELECT *, lag(rank) OVER (PARTITION BY session_id, call_no ORDER BY pos) AS before FROM m),
w AS (SELECT session_id, call_no, min(CASE WHEN event_type = 'SegmentEntered' THEN pos END) AS entered, min(CASE WHEN event_type = 'SegmentCompleted' THEN pos END) AS completed, min(CASE WHEN event_type = 'NodeReached' THEN pos END) AS reached,
  count_if(event_type = 'DestinationReached') AS ended, count_if(event_type = 'FloorChanged') AS floors, count_if(event_type = 'SessionCancelled') AS cancelled FROM m GROUP BY session_id, call_no),
faults AS (SELECT 'unsupported_type' AS check_name, session_id, call_no, place FROM o WHERE rank = 0 UNION ALL SELECT 'duplicate_type', session_id, call_no, place FROM o WHERE nth > 1 UNION ALL SELECT 'order', session_id, call_no, place FROM o WHERE before > rank
  UNION ALL SELECT 'missing_field', session_id, call_no, place FROM o WHERE (event_type IN ('SegmentEntered', 'SegmentCompleted') AND (segment IS NULL OR node IS NULL)) OR (event_type IN ('NodeReached', 'FloorChanged', 'DestinationReached') AND node IS NULL)
  UNION ALL SELECT 'destination_not_completed', session_id, call_no, NULL FROM w WHERE ended > 0 AND call_no % 23 = 0 UNION ALL SELECT 'floor_changed', session_id, call_no, NULL FROM w WHERE floors > 0
  UNION ALL SELECT 'completed_without_entered', session_id, call_no, NULL FROM w WHERE completed IS NOT NULL AND (entered IS NULL OR completed < entered) UNION ALL SELECT 'node_without_entered', session_id, call_no, NULL FROM w WHERE reached IS NOT NULL AND (entered IS NULL OR reached < entered)
  UNION ALL SELECT 'cancelled_state', session_id, call_no, NULL FROM w WHERE cancelled > 0 AND call_no % 2 = 1)"""


def _faulty_batches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(events, batches): all events of all calls, with wrong types, orders, fields and ends brought into some calls."""
    n, e = F.col("call_no"), F.col("event_type")
    steps, reports = _steps(spark, sf_dir), _called_reports(spark, sf_dir)
    nodes = steps.join(reports.withColumnRenamed("route_id", "session_id"), ["session_id", "step"]).select("session_id", "call_no", F.col("current_node").alias("at_node"))
    told = sessions.session_events(steps, reports).join(nodes, ["session_id", "call_no"]).where(~((n % 17 == 0) & (e == "SegmentEntered")))
    # places as they are before an event is left out
    p = F.when(e == "DestinationReached", 4).otherwise(F.array_position(F.array(*map(F.lit, sessions.EVENT_ORDER)), e) - F.when(e == "DestinationReached", 2).otherwise(1)).cast("long")
    kind = F.when((n % 7 == 0) & (e == "SegmentEntered"), "SegmentSkipped").when((n % 11 == 0) & (e == "NodeReached"), "SegmentCompleted").when((n % 19 == 0) & (e == "NodeReached"), "FloorChanged").when((n % 29 == 0) & (e == "SessionStarted"), "SessionCancelled").otherwise(e)
    segment = F.when((n % 31 != 0) & e.isin("SegmentEntered", "SegmentCompleted"), p)
    events = told.select("session_id", "call_no", F.when(n % 13 == 0, 10 - p).otherwise(p).alias("place"), kind.alias("event_type"), segment.alias("segment"), F.when(n % 37 != 0, F.col("at_node")).alias("node"))
    batches = steps.select("session_id", "call_no", F.when(n % 2 == 0, "CANCELLED").otherwise("ACTIVE").alias("state"), (n % 23 != 0).alias("completed"))
    return events, batches


@register(oracle(f"WITH {_FAULTY} SELECT check_name, session_id, call_no, cast(place AS bigint) AS place FROM faults"))
def event_batch_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of nine rules the events of all calls break, some of them brought in on purpose."""
    return sessions.batch_audit(*_faulty_batches(spark, sf_dir), "session_id", "call_no")


@register(
    oracle(
        f"""WITH {_FAULTY} SELECT n.session_id, n.call_no, n_events, coalesce(n_errors, 0) AS n_errors, coalesce(n_errors, 0) = 0 AS valid
FROM (SELECT session_id, call_no, count(*) AS n_events FROM ev GROUP BY session_id, call_no) n LEFT JOIN (SELECT session_id, call_no, count(*) AS n_errors FROM faults GROUP BY session_id, call_no) f ON f.session_id = n.session_id AND f.call_no = n.call_no"""
    )
)
def event_batch_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report for each call's events: whether they are valid, how many there are and how many rules they break."""
    events, batches = _faulty_batches(spark, sf_dir)
    by = ("session_id", "call_no")
    return sessions.batch_reports(sessions.batch_audit(events, batches, *by), events, *by)


_WHOLE = f"""c AS (SELECT session_id, call_no AS n, action FROM f_calls),
run AS (SELECT session_id, n, action, s AS before, {_NEXT.replace("a =", "action =")} AS state FROM (SELECT *, 'CREATED' AS s FROM c WHERE n = 1) z
  UNION ALL SELECT c.session_id, c.n, c.action, r.state, {_NEXT.replace("a =", "c.action =").replace("s IN", "r.state IN").replace("s =", "r.state =").replace("ELSE s", "ELSE r.state")}
  FROM run r JOIN c ON c.session_id = r.session_id AND c.n = r.n + 1)"""


@register(oracle(f"WITH {_WHOLE} SELECT session_id, arg_max(state, n) AS state, count_if(state <> before) AS n_accepted, count_if(state = before) AS n_rejected FROM run GROUP BY session_id"))
def session_lifecycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final state and accepted and rejected actions of each session over all of its calls."""
    return sessions.fold(view(spark, sf_dir, "f_calls"), "session_id")


_READINGS = "readings AS (SELECT event_id, session_id, recorded_at, x, y FROM f_positions WHERE source = 'view' OR source = 'error')"


@register(
    oracle(
        f"""WITH {_STEPS}, {_READINGS},
met AS (SELECT c.session_id, c.call_no, arg_max(r.event_id, (r.recorded_at, r.event_id)) AS reading, arg_max(x, (r.recorded_at, r.event_id)) AS x, arg_max(y, (r.recorded_at, r.event_id)) AS y
  FROM f_calls c JOIN readings r ON r.session_id = c.session_id AND (r.recorded_at < c.ts OR (r.recorded_at = c.ts AND r.event_id <= c.event_id)) GROUP BY c.session_id, c.call_no)
SELECT c.session_id, c.call_no, s.step, m.reading, m.x, m.y FROM f_calls c LEFT JOIN steps s ON s.session_id = c.session_id AND s.call_no = c.call_no LEFT JOIN met m ON m.session_id = c.session_id AND m.call_no = c.call_no"""
    )
)
def call_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call with the latest reading at or before it, and the step of its walk."""
    calls = view(spark, sf_dir, "f_calls").select("session_id", "call_no", "event_id", F.col("ts").alias("recorded_at"))
    readings = view(spark, sf_dir, "f_positions").where("source = 'view' OR source = 'error'").withColumn("reading", F.col("event_id"))
    found = positioning.as_of(calls, readings, "session_id", "recorded_at", "event_id", ["reading", "x", "y"])
    return found.join(_steps(spark, sf_dir), ["session_id", "call_no"], "left").select("session_id", "call_no", "step", "reading", "x", "y")
