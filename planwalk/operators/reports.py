"""Validation of replies and of written batches as a whole, and the report of each: whether it is valid, counts, statistics.

Snapshots, events and reports are as many as the calls, and their columns compress so well
that the size of a file or a shuffle says little about rows in memory.  So they are joined by
sorting both sides; none of them is sent to the driver to be broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwalk.operators.audits import failing, runtime_checks
from planwalk.operators.graphs import NODE_TYPES
from planwalk.operators.objects import RELATION_TYPES, STATUS_HOPS
from planwalk.operators.routing import TOLERANCE, violation
from planwalk.operators.sessions import EVENT_ORDER

STATUSES = (STATUS_HOPS[0][0], *(after for _, after in STATUS_HOPS))


def sorting(rows: DataFrame) -> DataFrame:
    """rows, to be joined by sorting."""
    return rows.hint("merge")


def reports(faults: DataFrame, subjects: DataFrame, *by: str, warnings: tuple[str, ...] = ()) -> DataFrame:
    """Every subject (by, any statistics) with valid, n_errors and n_warnings; faults: check_name, by.

    Checks named in `warnings` do not make a subject invalid.  Null keys meet null keys.
    """
    mild = F.col("check_name").isin(*warnings) if warnings else F.lit(False)
    counted = faults.groupBy(*(F.col(c).alias(f"_{c}") for c in by)).agg(F.count_if(~mild).alias("_errors"), F.count_if(mild).alias("_warnings"))
    same = reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
    n = {name: F.coalesce(f"_{name[2:]}", F.lit(0).cast("long")) for name in ("n_errors", "n_warnings")}
    return subjects.join(sorting(counted), same, "left").select(*subjects.columns, (n["n_errors"] == 0).alias("valid"), *(v.alias(k) for k, v in n.items()))


def _limbs(hashes: Column) -> tuple[Column, Column]:
    """Two halves of 64-bit hashes, whose sums stay within a long for up to 2^31 of them."""
    return F.shiftright(hashes, 32), hashes.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def visited_digest(nodes: Column) -> Column:
    """(n, high, low) of an array of nodes: what visited_prefixes holds for the same nodes in the same order."""
    hashes = F.transform(nodes, lambda v, k: F.xxhash64(v, k.cast("long")))
    total = lambda half: F.aggregate(hashes, F.lit(0).cast("long"), lambda acc, h: acc + _limbs(h)[half])
    return F.struct(F.size(nodes).cast("long").alias("n"), total(0).alias("high"), total(1).alias("low"))


def visited_prefixes(segments: DataFrame, routes: DataFrame) -> DataFrame:
    """(route_id, step, expected): digest of the nodes visited by the end of every step, 0 being the origin.

    A running sum of hashes of node and place, so a route of n segments takes n rows of fixed
    width where lists would take n^2 / 2 nodes.  Two different lists share a digest by accident
    with a probability of about 2^-64.
    """
    nodes = segments.select("route_id", F.col("sequence").cast("long").alias("step"), F.col("target").alias("node"))
    nodes = nodes.unionByName(routes.select("route_id", F.lit(0).cast("long").alias("step"), F.col("origin").alias("node")))
    along = Window.partitionBy("route_id").orderBy("step")
    nodes = nodes.withColumn("n", F.row_number().over(along).cast("long"))
    high, low = _limbs(F.xxhash64("node", F.col("n") - 1))
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return nodes.select("route_id", "step", F.struct("n", F.sum(high).over(so_far).alias("high"), F.sum(low).over(so_far).alias("low")).alias("expected"))


def event_faults(events: DataFrame, states: DataFrame, *by: str, must_end: bool = False) -> DataFrame:
    """(check_name, by, place): events that do not fit the snapshot they were told with; place is null for rules over a batch.

    events: by, place, event_type, event_session, event_route; states: by, session, route, state,
    completed.  Of an event: unsupported_type, duplicate_type, order (the one before comes later
    in EVENT_ORDER, unsupported ones come first), other_session, other_route.  Of a batch:
    destination_not_completed, cancelled_state, and with `must_end` completed_without_destination,
    which a snapshot without any events breaks too.  Events of equal place count in the order of
    their types.
    """
    kind = F.col("event_type")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, EVENT_ORDER)), kind), F.lit(0))
    order = Window.partitionBy(*by).orderBy("place", "event_type")
    rows = events.join(sorting(states.select(*by, "session", "route")), list(by)).withColumns(
        {"rank": rank, "before": F.lag(rank).over(order), "nth": F.row_number().over(Window.partitionBy(*by, "event_type").orderBy("place"))}
    )
    checks = {
        "unsupported_type": F.col("rank") == 0,
        "duplicate_type": F.col("nth") > 1,
        "order": F.col("before") > F.col("rank"),
        "other_session": ~F.col("event_session").eqNullSafe(F.col("session")),
        "other_route": ~F.col("event_route").eqNullSafe(F.col("route")),
    }
    told = failing(rows, checks, *by, "place")
    ends = events.groupBy(*by).agg(F.max(kind == "DestinationReached").alias("reached"), F.max(kind == "SessionCancelled").alias("cancelled"))
    reached, cancelled = (F.coalesce(c, F.lit(False)) for c in ("reached", "cancelled"))
    done = F.coalesce("completed", F.lit(False))
    checks = {"destination_not_completed": reached & ~done, "cancelled_state": cancelled & ~F.coalesce(F.col("state") == "CANCELLED", F.lit(False))}
    if must_end:
        checks = {"destination_not_completed": reached & ~done, "completed_without_destination": ~reached & done}
    whole = states.join(sorting(ends), list(by), "left").withColumn("place", F.lit(None).cast("long"))
    return told.unionByName(failing(whole, checks, *by, "place"))


def session_audit(snapshots: DataFrame, prefixes: DataFrame, events: DataFrame, *by: str) -> DataFrame:
    """(check_name, by, place): what is wrong with a session's snapshots, their visited nodes, distances and events.

    snapshots: by, session, route, and the columns of audits.runtime_audit, visited (array of
    nodes) and remaining_distance; events as in event_faults.  The visited nodes of a snapshot are
    held against visited_prefixes of its step by length and digest.
    """
    visited, left = F.col("visited"), F.col("remaining_distance")
    some = F.coalesce(F.size(visited) > 0, F.lit(False))
    checks = {name: held for name, held in runtime_checks().items() if name != "step_percentage"} | {
        "visited_missing": ~some,
        "visited_duplicates": some & (F.size(F.array_distinct(visited)) < F.size(visited)),
        "visited_end": some & ~F.try_element_at(visited, F.lit(-1)).eqNullSafe(F.col("current_node")),
        "visited_wrong": some & ~visited_digest(visited).eqNullSafe(F.col("expected")),
        "remaining_distance": left.isNull() | F.isnan(left) | (left < 0) | (left == float("inf")),
        "completed_with_distance": F.col("completed") & (left > TOLERANCE) & (left < float("inf")),
    }
    known = prefixes.select(F.col("route_id").alias("route"), "step", "expected")
    rows = snapshots.join(sorting(known), ["route", "step"], "left").withColumn("place", F.lit(None).cast("long"))
    return failing(rows, checks, *by, "place").unionByName(event_faults(events, snapshots, *by))


def position_audit(snapshots: DataFrame, events: DataFrame, *by: str) -> DataFrame:
    """(check_name, by, place): what is wrong with snapshots that follow a position, and with their events.

    snapshots: by, session, route, provider, error, position (graph_id, source, x, y, recorded_at),
    nearest_node, segment (id, source, target, sequence; null at the origin), current_node,
    percentage, remaining_segments, remaining_cost, completed.  A snapshot with an error has that
    fault alone, and no events.  The share of segments done is reckoned from sequence and
    remainder, and not of a segment that is malformed.
    """
    empty = lambda c: F.coalesce(c.cast("string"), F.lit("")) == ""
    at, seg = F.col("position"), F.col("segment")
    sound = F.col("error").isNull()
    given, on_way = at.isNotNull(), seg.isNotNull()
    malformed = on_way & (empty(seg["id"]) | empty(seg["source"]) | empty(seg["target"]) | seg["sequence"].isNull())
    misplaced = on_way & ~malformed & (seg["sequence"] < 1)
    done = F.when(on_way, seg["sequence"]).otherwise(0)
    total = F.when(~malformed & ~misplaced, done + F.col("remaining_segments"))
    shared = ("percentage_range", "remaining_segments", "remaining_cost")
    full = F.coalesce(F.abs(F.col("percentage") - 100) < TOLERANCE, F.lit(False))
    checks = {
        "no_provider": empty(F.col("provider")),
        "no_position": ~given,
        "missing_graph_id": given & empty(at["graph_id"]),
        "missing_source": given & empty(at["source"]),
        "missing_coordinates": given & F.coalesce(at["x"], at["y"]).isNull(),
        "missing_recorded_at": given & at["recorded_at"].isNull(),
        "no_nearest_node": F.col("nearest_node").isNull(),
        "malformed_segment": malformed,
        "foreign_segment": misplaced,
        "other_node": F.col("nearest_node").isNotNull() & ~F.col("nearest_node").eqNullSafe(F.col("current_node")),
        "completed_below_100": F.col("completed") & ~full,
        "full_not_completed": ~F.coalesce("completed", F.lit(False)) & full,
        "step_percentage": (total > 0) & (F.abs(done / total * 100 - F.col("percentage")) > TOLERANCE),
    } | {name: held for name, held in runtime_checks().items() if name in shared}
    checks = {"runtime_error": ~sound} | {name: sound & held for name, held in checks.items()}
    rows = snapshots.withColumn("place", F.lit(None).cast("long"))
    return failing(rows, checks, *by, "place").unionByName(event_faults(events, snapshots.where(sound).withColumn("state", F.lit(None).cast("string")), *by, must_end=True))


def routing_reports(faults: DataFrame, routes: DataFrame) -> DataFrame:
    """(request_id, valid, n_errors, n_routes, n_failed, n_preferences, avg_cost, avg_hops): what the audit of a request's offered routes comes to."""
    bad = faults.where("route_id IS NOT NULL").select("route_id", F.lit(True).alias("bad")).distinct()
    none = F.max(F.col("preference").isNull().cast("long"))
    per = routes.join(bad, "route_id", "left").groupBy("request_id").agg(
        F.count_if(F.col("bad").isNull()).alias("n_routes"), F.count_if(F.col("bad")).alias("n_failed"),
        (F.countDistinct("preference") + none).alias("n_preferences"), F.avg("total_cost").alias("avg_cost"), F.avg("hop_count").alias("avg_hops"),
    )
    return reports(faults, per, "request_id").drop("n_warnings")


def production_audit(objects: DataFrame, candidates: DataFrame, relationships: DataFrame) -> DataFrame:
    """(check_name, batch_id, key): what is wrong with the objects and relationships that were written for each batch.

    objects: ord, batch_id, uso_id, model_id, collection, candidate_id, reference, status;
    candidates: model_id, collection, candidate_id; relationships: ord, batch_id, src, dst,
    relation.  An object of another model than the batch's is an orphan and counts for nothing
    else.  Of repeats all but the first by ord are told; null candidates repeat each other.
    """
    own = F.col("model_id").eqNullSafe(F.col("batch_id"))
    out = objects.where(~own).select(*violation("orphan_object", "batch_id", F.col("ord").alias("key")))
    kept = objects.where(own)
    nth = {f"nth_{c}": F.row_number().over(Window.partitionBy("batch_id", c).orderBy("ord")) for c in ("uso_id", "candidate_id")}
    there = candidates.select(F.col("model_id").alias("batch_id"), "collection", "candidate_id", F.lit(True).alias("there")).distinct()
    checks = {
        "duplicate_object": F.col("nth_uso_id") > 1,
        "duplicate_candidate": F.col("nth_candidate_id") > 1,
        "missing_reference": F.coalesce(F.col("reference").cast("string"), F.lit("")) == "",
        "missing_candidate": F.col("there").isNull(),
        "invalid_status": ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)),
    }
    rows = kept.withColumns(nth).join(there, ["batch_id", "collection", "candidate_id"], "left")
    out = out.unionByName(failing(rows, checks, "batch_id", F.col("ord").alias("key")))
    # only what is needed of the ends, once each
    ids = kept.select("batch_id", "uso_id").distinct()
    ends = relationships
    for end in ("src", "dst"):
        ends = ends.join(ids.select("batch_id", F.col("uso_id").alias(end), F.lit(True).alias(f"has_{end}")), ["batch_id", end], "left")
    checks = {
        "self_relation": F.col("src") == F.col("dst"),
        "orphan_relation": F.col("has_src").isNull() | F.col("has_dst").isNull(),
        "unknown_type": ~F.coalesce(F.col("relation").isin(*RELATION_TYPES), F.lit(False)),
    }
    return out.unionByName(failing(ends, checks, "batch_id", F.col("ord").alias("key")))


def semantic_production_audit(objects: DataFrame, models: DataFrame) -> DataFrame:
    """(check_name, ord, uso_id): models (ord, uso_id, semantic_category, lifecycle, confidence) that do not fit the batch's objects.

    An orphan has no other fault.  no_confidence is a warning: a category with a confidence of 0.
    """
    known = objects.select("uso_id", F.lit(True).alias("there")).distinct()
    rows = models.join(known, "uso_id", "left").withColumn("nth", F.row_number().over(Window.partitionBy("uso_id").orderBy("ord")))
    there, sure = F.col("there").isNotNull(), F.col("confidence")
    checks = {
        "orphan": ~there,
        "duplicate": there & (F.col("nth") > 1),
        "invalid_lifecycle": there & ~F.coalesce(F.col("lifecycle").isin(*STATUSES), F.lit(False)),
        "confidence_range": there & ~F.coalesce(sure.between(0, 1), F.lit(False)),
        "no_confidence": there & (F.coalesce("semantic_category", F.lit("")) != "") & (sure == 0),
    }
    return failing(rows, checks, "ord", "uso_id")


def status_changes(asked: DataFrame, objects: DataFrame) -> DataFrame:
    """(uso_id, ord, wanted, before, accepted): changes of status that are asked for, in the order of (ord, wanted).

    A change is accepted if it is the hop that may follow the status at that point.  As statuses
    are one chain, the place at which an object reaches each is a running minimum over the
    places after the one before: one sort, no state per object.  Unknown objects have no status
    and accept nothing; null statuses are never accepted.
    """
    along = Window.partitionBy("uso_id").orderBy("ord", "wanted")
    so_far = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = asked.select("uso_id", "ord", "wanted").join(objects.select("uso_id", "status"), "uso_id", "left").withColumn("nth", F.row_number().over(along))
    rows = rows.withColumn("at_0", F.when(F.col("status") == STATUSES[0], 0))
    for k, status in enumerate(STATUSES[1:], 1):
        hop = F.min(F.when((F.col("wanted") == status) & (F.col(f"at_{k - 1}") < F.col("nth")), F.col("nth"))).over(so_far)
        rows = rows.withColumn(f"at_{k}", F.when(F.col("status") == status, 0).otherwise(hop))
    accepted = F.lit(False)
    before = F.col("status")
    for k, status in enumerate(STATUSES):
        accepted |= (F.col("wanted") == status) & (F.col(f"at_{k}") == F.col("nth"))
        before = F.when(F.col(f"at_{k}") < F.col("nth"), status).otherwise(before)
    return rows.select("uso_id", "ord", "wanted", before.alias("before"), F.coalesce(accepted, F.lit(False)).alias("accepted"))


def detection_audit(graphs: DataFrame, models: DataFrame, detections: DataFrame) -> DataFrame:
    """(check_name, graph_id, key): what is wrong with what candidates are detected in, and with what is detected.

    graphs: graph_id; models: graph_id, model_id, uso_id; detections: ord, graph_id, model_id,
    candidate_type.  Errors: missing_object, unknown_type, duplicate_detection (all but the
    first by ord of a graph's model).  Warnings, without a key: no_models, no_detections.
    """
    out = models.where("uso_id IS NULL").select(*violation("missing_object", "graph_id", F.col("model_id").alias("key")))
    rows = detections.withColumn("nth", F.row_number().over(Window.partitionBy("graph_id", "model_id").orderBy("ord")))
    checks = {"unknown_type": ~F.coalesce(F.col("candidate_type").isin(*NODE_TYPES), F.lit(False)), "duplicate_detection": F.col("nth") > 1}
    out = out.unionByName(failing(rows, checks, "graph_id", F.col("ord").alias("key")))
    for name, found in (("no_models", models), ("no_detections", detections)):
        without = graphs.select("graph_id").distinct().join(found.select("graph_id"), "graph_id", "left_anti")
        out = out.unionByName(without.select(*violation(name, "graph_id", F.lit(None).cast("long").alias("key"))))
    return out


#: Checks of detection_audit and semantic_production_audit that leave a batch valid.
WARNINGS = ("no_models", "no_detections", "no_confidence")
