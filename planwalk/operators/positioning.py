"""Positions: nearest nodes, segments, snapshots, the mock provider and their audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planwalk.functions import geometry
from planwalk.operators.routing import violation
from planwalk.sources.scratch import written


def latest(positions: DataFrame, *by: str) -> DataFrame:
    """The newest reading of each group; of equal times the one with the largest event_id."""
    newest = F.max_by(F.struct("event_id", "x", "y", "recorded_at"), F.struct("recorded_at", "event_id"))
    return positions.groupBy(*by).agg(newest.alias("m")).select(*by, "m.event_id", "m.x", "m.y")


def nearest_node(positions: DataFrame, nodes: DataFrame, cell: float = 10.0) -> DataFrame:
    """(event_id, node_id, distance) of the nearest node with coordinates in the position's graph; ties go to the smaller ord.

    Positions at one place are resolved once, and of nodes at one place the first stands for
    all.  A place meets the nodes of its cell and of those around it; what is found within
    the width of a cell is nearest.  Places that are still open carry on with cells twice as
    wide, until the cells around one hold everything, so there are few rounds and no place
    meets all nodes of its graph.
    """
    at = ["graph_id", "x", "y"]
    usable = nodes.where("x IS NOT NULL AND y IS NOT NULL").groupBy("graph_id", F.col("x").alias("nx"), F.col("y").alias("ny"))
    usable = written(usable.agg(F.min_by("node_id", F.struct("ord", "node_id")).alias("node_id"), F.min("ord").alias("ord")), "node-places")
    places = written(positions.select(*at).where("x IS NOT NULL AND y IS NOT NULL").distinct(), "places")
    ends = [r for r in (usable.agg(*(f(c) for c in ("nx", "ny") for f in (F.min, F.max))).first(), places.agg(*(f(c) for c in ("x", "y") for f in (F.min, F.max))).first()) if r[0] is not None]
    reach = max((max(r[1] for r in ends) - min(r[0] for r in ends), max(r[3] for r in ends) - min(r[2] for r in ends))) if ends else 0.0
    around = F.array(*(F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    d = geometry.distance(F.col("x"), F.col("y"), F.col("nx"), F.col("ny"))
    found, still = None, places
    while True:
        here = usable.withColumns({"i": F.floor(F.col("nx") / cell), "j": F.floor(F.col("ny") / cell)})
        asked = still.select(*at, F.inline(around)).withColumns({"i": F.floor(F.col("x") / cell) + F.col("di"), "j": F.floor(F.col("y") / cell) + F.col("dj")})
        best = asked.join(here, ["graph_id", "i", "j"]).groupBy(*at).agg(F.min(F.struct(d.alias("distance"), "ord", "node_id")).alias("m"))
        last = cell >= reach
        best = written(best.select(*at, "m.node_id", "m.distance").where(F.lit(last) | (F.col("m.distance") <= cell)), "nearest")
        found = best if found is None else found.unionByName(best)
        if last:
            break
        still = written(still.join(best, at, "left_anti"), "places")
        if still.isEmpty():
            break
        cell *= 2
    return positions.join(found, at).select("event_id", "session_id", "graph_id", "node_id", "distance")


def resolve_segment(nearest: DataFrame, segments: DataFrame, routes: DataFrame) -> DataFrame:
    """(event_id, step): 0 at the route's origin, else the first segment that ends at the node, else null.

    nearest: event_id, route_id, node; segments: route_id, sequence, target; routes: route_id, origin.
    """
    ends = segments.groupBy("route_id", F.col("target").alias("node")).agg(F.min("sequence").alias("sequence"))
    r = nearest.join(routes.select("route_id", "origin"), "route_id").join(ends, ["route_id", "node"], "left")
    return r.select("event_id", "route_id", "node", F.when(F.col("node") == F.col("origin"), 0).otherwise(F.col("sequence")).cast("long").alias("step"))


def mock_positions(requests: DataFrame, simulated: DataFrame) -> DataFrame:
    """Provider positions: the simulated node's coordinates if there are any, else those hashed from graph and source."""
    hx, hy = geometry.hash_coordinates(F.concat_ws(":", "graph_id", "source"))
    r = requests.join(simulated, ["graph_id", "source"], "left")
    return r.select("graph_id", "source", F.coalesce("x", hx.cast("double")).alias("x"), F.coalesce("y", hy.cast("double")).alias("y"))


def node_coordinates(nodes: DataFrame) -> DataFrame:
    """Nodes with coordinates hashed from their id where they have none."""
    hx, hy = geometry.hash_coordinates(F.col("node_id"))
    return nodes.select("graph_id", "node_id", F.coalesce("x", hx.cast("double")).alias("x"), F.coalesce("y", hy.cast("double")).alias("y"))


def snapshot_audit(snapshots: DataFrame, totals: DataFrame) -> DataFrame:
    """(check_name, session_id, call_no): percentages that do not follow from the step, steps beyond the route, completion without the last step."""
    r = snapshots.join(totals.withColumnRenamed("route_id", "session_id"), "session_id")
    out = r.where("abs(step / total * 100 - percentage) > 1e-9").select(*violation("percentage", "session_id", "call_no"))
    out = out.unionByName(r.where("step > total").select(*violation("beyond_route", "session_id", "call_no")))
    return out.unionByName(r.where("completed <> (step = total)").select(*violation("completed", "session_id", "call_no")))


def window_counts(positions: DataFrame, width: str = "1 hour") -> DataFrame:
    """Readings per source and tumbling window."""
    w = F.window(F.col("recorded_at").cast("timestamp"), width)
    return positions.groupBy(w.alias("w"), "source").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "source", "n")


def numbered(rows: DataFrame, by: str, order: str) -> DataFrame:
    return rows.withColumn("version", F.row_number().over(Window.partitionBy(by).orderBy(order)))


def as_of(calls: DataFrame, readings: DataFrame, session: str, at: str, tie: str, values: list[str], since: Column | None = None) -> DataFrame:
    """calls with `values` of the latest reading of their session at or before them, by (at, tie); null where there is none.

    Both tables have session, at and tie.  Time is cut into periods (`since` of `at`; days by
    default): within one, calls and readings are ordered together, and a period's last reading
    is carried on to the calls of later ones that come before any reading of their own.  So a
    session of any length is dealt to many tasks.  Columns of calls may not be named like values.
    """
    period = F.date_trunc("day", F.col(at)) if since is None else since
    key = F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"))
    read = F.struct(key.alias("key"), *values)
    of_readings = readings.select(session, period.alias("_period"), key.alias("_key"), F.lit(0).alias("_last"), read.alias("_read"))
    of_calls = calls.select(session, period.alias("_period"), key.alias("_key"), F.lit(1).alias("_last"), F.struct(*calls.columns).alias("_call"))
    order = Window.partitionBy(session, "_period").orderBy("_key", "_last")
    both = of_calls.unionByName(of_readings, allowMissingColumns=True)
    within = both.withColumn("_own", F.last("_read", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("_last = 1")
    ends = of_readings.groupBy(session, "_period").agg(F.max("_read").alias("_end"))
    periods = within.select(session, "_period").distinct().join(ends, [session, "_period"], "full")
    before = Window.partitionBy(session).orderBy("_period").rowsBetween(Window.unboundedPreceding, -1)
    carried = periods.withColumn("_carried", F.last("_end", ignorenulls=True).over(before)).select(session, "_period", "_carried")
    found = within.join(carried, [session, "_period"]).withColumn("_found", F.coalesce("_own", "_carried"))
    return found.select("_call.*", *(F.col("_found")[v].alias(v) for v in values))
