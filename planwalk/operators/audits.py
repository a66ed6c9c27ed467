"""Audits that name every rule a row breaks, and the validation steps between candidates, objects, nodes and routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwalk.operators.graphs import structure_audit
from planwalk.operators.routing import TOLERANCE, violation

#: Collection of candidates, then the category of the objects made of it.
COLLECTIONS = (
    ("candidateBoundaries", "BOUNDARY"),
    ("candidateEnclosures", "ENCLOSURE"),
    ("candidateOpenings", "OPENING"),
    ("candidateWalls", "WALL"),
    ("candidatePassages", "PASSAGE"),
    ("candidateVerticalConnections", "VERTICAL_CONNECTION"),
)


def failing(rows: DataFrame, checks: dict[str, Column], *keys: str) -> DataFrame:
    """(check_name, keys): a row for every check that holds, all of them in one pass; a check that is null does not hold."""
    told = F.array_compact(F.array(*(F.when(held, name) for name, held in checks.items())))
    return rows.select(F.explode(told).alias("check_name"), *keys)


def _missing(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""


def candidate_reasons(candidates: DataFrame, *references: str) -> DataFrame:
    """Adds reason: why a candidate (ord, collection, candidate_id) is skipped, else null.

    Of candidates with one id in a collection the first that refers to geometry stays; a
    repeated row counts as a duplicate only if its ord is larger.  Rows without an id are
    kept out of the join, however many there are.
    """
    empty = F.coalesce(*references).isNull()
    named = candidates.where(~_missing("candidate_id"))
    first = named.where(~empty).groupBy("collection", "candidate_id").agg(F.min("ord").alias("first"))
    found = named.join(first, ["collection", "candidate_id"], "left")
    found = found.withColumn("reason", F.when(F.col("ord") > F.col("first"), "duplicate").when(empty, "empty_reference")).drop("first")
    return found.unionByName(candidates.where(_missing("candidate_id")).withColumn("reason", F.lit("missing_id")))


def objects_of(candidates: DataFrame, *references: str) -> DataFrame:
    """(collection, candidate_id, spatial_category, primitive_ids) of the candidates that validation leaves."""
    category = F.create_map(*(F.lit(x) for pair in COLLECTIONS for x in pair))
    kept = candidate_reasons(candidates, *references).where("reason IS NULL")
    return kept.select("collection", "candidate_id", category[F.col("collection")].alias("spatial_category"), F.array_compact(F.array(*references)).alias("primitive_ids"))


def semantic_input_reasons(objects: DataFrame, modelled: DataFrame) -> DataFrame:
    """(ord, uso_id, reason) of objects (ord, uso_id, traversable) to be classified: why one is skipped, null if it is not.

    Of rows with one id the first by ord counts; an object without flags or with a model is skipped.
    """
    named = objects.where("uso_id IS NOT NULL")
    first = named.groupBy("uso_id").agg(F.min("ord").alias("first"))
    found = named.join(first, "uso_id").join(modelled.select("uso_id", F.lit(True).alias("has_model")).distinct(), "uso_id", "left")
    reason = F.when(F.col("ord") > F.col("first"), "duplicate").when(F.col("traversable").isNull(), "missing_accessibility").when(F.col("has_model"), "already_modelled")
    out = found.select("ord", "uso_id", reason.alias("reason"))
    return out.unionByName(objects.where("uso_id IS NULL").select("ord", "uso_id", F.lit("missing_id").alias("reason")))


def position_audit(positions: DataFrame, *keys: str) -> DataFrame:
    """Positions without graph, source, coordinates or time."""
    checks = {f"missing_{c}": _missing(c) for c in ("graph_id", "source", "recorded_at")}
    return failing(positions, checks | {"missing_coordinates": F.coalesce("x", "y").isNull()}, *keys)


def node_audit(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """(check_name, graph_id, key): graphs whose nodes are not as many as their candidates, nodes without type, candidates or objects with several nodes."""
    def count(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("graph_id").agg(F.count(F.lit(1)).alias(name))

    n = F.coalesce("n_nodes", F.lit(0)) != F.coalesce("n_candidates", F.lit(0))
    out = count(candidates, "n_candidates").join(count(nodes, "n_nodes"), "graph_id", "full").where(n).select(*violation("count", "graph_id", F.lit(None).cast("long").alias("key")))
    out = out.unionByName(nodes.where(_missing("node_type")).select(*violation("missing_type", "graph_id", F.col("candidate_id").alias("key"))))
    for name, column in (("duplicate_candidate", "candidate_id"), ("duplicate_object", "object_id")):
        again = nodes.groupBy("graph_id", column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        out = out.unionByName(again.select(*violation(name, "graph_id", F.col(column).alias("key"))))
    return out


def edge_audit(graphs: DataFrame, nodes: DataFrame, edges: DataFrame, order: str) -> DataFrame:
    """(check_name, graph_id, order): edges of graphs that are not asked for, and what the structure audit finds in the others."""
    foreign = edges.join(graphs.select("graph_id"), "graph_id", "left_anti").select(*violation("foreign_graph", "graph_id", order))
    return foreign.unionByName(structure_audit(nodes, edges.join(graphs.select("graph_id"), "graph_id", "left_semi"), order))


def route_facts(stops: DataFrame, routes: DataFrame, edges: DataFrame, cost: Column) -> DataFrame:
    """(route_id, first, last, n_hops, n_missing, n_bad, summed) of each route's stops (route_id, place, node); `cost` is the effective cost of an edge under the route's preference."""
    hops = stops.withColumn("next", F.lead("node").over(Window.partitionBy("route_id").orderBy("place", "node")))
    hops = hops.join(routes.select("route_id", "preference"), "route_id").join(edges.select(F.col("src").alias("node"), F.col("dst").alias("next"), F.col("cost")), ["node", "next"], "left")
    hop, known = F.col("next").isNotNull(), F.col("cost").isNotNull()
    sound = (cost > 0) & (cost < float("inf"))
    return hops.groupBy("route_id").agg(
        F.min_by("node", F.struct("place", "node")).alias("first"),
        F.max_by("node", F.struct("place", "node")).alias("last"),
        F.count_if(hop).alias("n_hops"),
        F.count_if(hop & ~known).alias("n_missing"),
        F.count_if(known & ~sound).alias("n_bad"),
        F.coalesce(F.sum(F.when(sound, cost)), F.lit(0.0)).alias("summed"),
    )


def routing_audit(routes: DataFrame, stops: DataFrame, asked: DataFrame, contexts: DataFrame, edges: DataFrame, cost: Column) -> DataFrame:
    """(check_name, request_id, route_id): what is wrong with the routes offered in reply to requests.

    routes: request_id, route_id, context_id, preference, hop_count, total_cost, in the order of
    route_id; asked: request_id, origin, destination; contexts: context_id.  A reply whose
    contexts are not those asked for in ascending order has one more row without a route.
    """
    reply = Window.partitionBy("request_id").orderBy("route_id")
    rows = routes.join(route_facts(stops, routes, edges, cost), "route_id", "left").join(asked, "request_id", "left").join(contexts.select("context_id", F.lit(True).alias("wanted")).distinct(), "context_id", "left")
    rows = rows.withColumn("before", F.lag("context_id").over(reply))
    for c in ("context_id", "preference"):
        rows = rows.withColumn(f"nth_{c}", F.row_number().over(Window.partitionBy("request_id", c).orderBy("route_id")))
    whole = ~(_missing("context_id") | _missing("preference") | F.col("total_cost").isNull() | F.col("hop_count").isNull() | F.col("first").isNull())
    checks = {
        "missing_field": ~whole,
        "foreign_context": F.col("wanted").isNull(),
        "duplicate_context": F.col("nth_context_id") > 1,
        "duplicate_preference": F.col("nth_preference") > 1,
        "origin": whole & (F.col("first") != F.col("origin")),
        "destination": whole & (F.col("last") != F.col("destination")),
        "hop_count": whole & (F.col("hop_count") != F.col("n_hops")),
        "missing_edge": whole & (F.col("n_missing") > 0),
        "bad_cost": whole & (F.col("n_bad") > 0),
        "cost_sum": whole & (F.col("n_missing") + F.col("n_bad") == 0) & (F.abs(F.col("summed") - F.col("total_cost")) > TOLERANCE),
    }
    disorder = rows.where("wanted IS NULL OR context_id <= before").select("request_id").distinct()
    return failing(rows, checks, "request_id", "route_id").unionByName(disorder.select(*violation("order", "request_id", F.lit(None).cast("long").alias("route_id"))))


def runtime_checks() -> dict[str, Column]:
    """Checks of a snapshot's state, step, total, current_node, current_segment, remaining_segments, remaining_cost, percentage and completed."""
    per, done, left, cost = (F.col(c) for c in ("percentage", "completed", "remaining_segments", "remaining_cost"))
    full = F.abs(per - 100) < TOLERANCE
    within = per.between(0, 100)
    return {
        "state": F.col("state") != "ACTIVE",
        "no_node": F.col("current_node").isNull(),
        "no_segment": F.col("current_segment").isNull(),
        "remaining_segments": left.isNull() | (left < 0),
        "completed_with_segments": done & (left > 0),
        "remaining_cost": cost.isNull() | F.isnan(cost) | (cost < 0) | (cost == float("inf")),
        "completed_with_cost": done & (cost > TOLERANCE),
        "percentage_range": per.isNull() | ~within,
        "completed_below_100": within & done & ~full,
        "full_not_completed": within & ~done & full,
        "step_percentage": F.abs(F.col("step") / F.col("total") * 100 - per) > TOLERANCE,
    }


def runtime_audit(snapshots: DataFrame, *keys: str) -> DataFrame:
    """What is wrong with reported snapshots: state, step, total, current_node, current_segment, remaining_segments, remaining_cost, percentage, completed."""
    return failing(snapshots, runtime_checks(), *keys)
