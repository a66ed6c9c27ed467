"""Session lifecycle, progress along a route, events, and their audits, over ordered call tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwalk.operators.routing import violation

#: Fixed values: (action, states it may start from, state it leads to).
TRANSITIONS = (
    ("START", ("CREATED", "READY"), "ACTIVE"),
    ("PAUSE", ("ACTIVE",), "PAUSED"),
    ("RESUME", ("PAUSED",), "ACTIVE"),
    ("CANCEL", ("ACTIVE", "PAUSED"), "CANCELLED"),
    ("COMPLETE", ("ACTIVE",), "COMPLETED"),
)
#: The order in which events of one step are told.
EVENT_ORDER = ("SessionStarted", "SegmentEntered", "SegmentCompleted", "NodeReached", "FloorChanged", "DestinationReached", "SessionCancelled")


def next_state(state: Column, action: Column) -> Column:
    """State after an action; an action that is not allowed leaves the state as it is."""
    out = state
    for name, sources, target in TRANSITIONS:
        out = F.when((action == name) & state.isin(*sources), target).otherwise(out)
    return out


#: Calls of a group that are folded at once.
BLOCK = 1024
STATES = ("CREATED", "READY", "ACTIVE", "PAUSED", "CANCELLED", "COMPLETED")


def fold(calls: DataFrame, *by: str, block: int = BLOCK) -> DataFrame:
    """Per group: final state, accepted and rejected actions, from calls in the order of call_no.

    Actions compose: what a run of calls makes of each state it may start from can be told
    without knowing where it starts.  So calls are folded in blocks of `block` numbers, the
    first of a group from CREATED and any other from every state, and blocks are then chained.
    A session of any length is dealt to many tasks, and the last step takes a row per block.
    """
    start = lambda s: F.struct(s.alias("state"), F.lit(0).cast("long").alias("n_accepted"), F.lit(0).cast("long").alias("n_rejected"))

    def step(acc: Column, call: Column) -> Column:
        after = next_state(acc["state"], call["action"])
        ok = (after != acc["state"]).cast("long")
        return F.struct(after.alias("state"), (acc["n_accepted"] + ok).alias("n_accepted"), (acc["n_rejected"] + 1 - ok).alias("n_rejected"))

    def chain(acc: Column, part: Column) -> Column:
        went = F.get(part["ends"], F.when(F.size(part["ends"]) == 1, 0).otherwise(F.array_position(F.array(*map(F.lit, STATES)), acc["state"]).cast("int") - 1))
        return F.struct(went["state"].alias("state"), *((acc[n] + went[n]).alias(n) for n in ("n_accepted", "n_rejected")))

    blocks = calls.groupBy(*by, F.floor(F.col("call_no") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("call_no", "action"))).alias("steps"))
    # the number of a group's first block, from narrow rows
    first = calls.groupBy(*by).agg(F.floor(F.min("call_no") / block).alias("first"))
    blocks = blocks.join(first, list(by))
    every = F.transform(F.array(*map(F.lit, STATES)), lambda s: F.aggregate("steps", start(s), step))
    ends = F.when(F.col("block") == F.col("first"), F.array(F.aggregate("steps", start(F.lit("CREATED")), step))).otherwise(every)
    parts = F.array_sort(F.collect_list(F.struct("block", ends.alias("ends"))))
    folded = blocks.groupBy(*by).agg(parts.alias("parts")).select(*by, F.aggregate("parts", start(F.lit("CREATED")), chain).alias("f"))
    return folded.select(*by, "f.state", "f.n_accepted", "f.n_rejected")


def walk_steps(calls: DataFrame, totals: DataFrame) -> DataFrame:
    """(session_id, call_no, step): every call moves a session one segment on until the last of `total`."""
    return calls.join(totals, "session_id").select("session_id", "call_no", F.least(F.col("call_no") - 1, F.col("total")).alias("step"))


def totals(segments: DataFrame) -> DataFrame:
    return segments.groupBy("route_id").agg(F.count(F.lit(1)).alias("total"))


def visited(segments: DataFrame, routes: DataFrame) -> DataFrame:
    """(route_id, sequence, visited): origin and targets up to each segment, joined by `>`."""
    so_far = Window.partitionBy("route_id").orderBy("sequence").rowsBetween(Window.unboundedPreceding, 0)
    return segments.join(routes.select("route_id", "origin"), "route_id").select("route_id", "sequence", F.concat_ws(">", "origin", F.concat_ws(">", F.collect_list("target").over(so_far))).alias("visited"))


def progress(segments: DataFrame, routes: DataFrame) -> DataFrame:
    """What a session on a route would report at every step from 0 (origin) to the last segment; cost is split evenly over segments."""
    n = totals(segments).join(routes, "route_id")
    per = F.col("total_cost") / F.col("total")
    at_origin = n.select("route_id", F.lit(0).cast("long").alias("step"), F.lit(None).cast("long").alias("current_segment"), F.col("origin").alias("current_node"), "total", per.alias("per"))
    on_way = segments.join(n, "route_id").select("route_id", F.col("sequence").cast("long").alias("step"), F.col("sequence").cast("long").alias("current_segment"), F.col("target").alias("current_node"), "total", per.alias("per"))
    left = F.col("total") - F.col("step")
    return at_origin.unionByName(on_way).select(
        "route_id", "step", "current_segment", "current_node", left.alias("remaining_segments"), (F.col("per") * left).alias("remaining_cost"),
        (F.col("step") / F.col("total") * 100).alias("percentage"), (left == 0).alias("completed"),
    )


def progress_audit(reported: DataFrame, expected: DataFrame) -> DataFrame:
    """(check_name, route_id, step): reports outside 0..100, with a remainder that does not fit, or completed without 100 %."""
    r = reported.join(expected.select("route_id", "total"), "route_id")
    out = r.where("percentage < 0 OR percentage > 100").select(*violation("percentage_range", "route_id", "step"))
    out = out.unionByName(r.where("remaining_segments <> total - step").select(*violation("remaining_segments", "route_id", "step")))
    out = out.unionByName(r.where("completed <> (percentage = 100)").select(*violation("completed", "route_id", "step")))
    return out.unionByName(r.where("step > 0 AND current_segment IS NULL").select(*violation("no_segment", "route_id", "step")))


def events_of(state: Column, has_segment: Column, completed: Column) -> Column:
    """Array of event types that one report gives."""
    told = F.array(
        F.lit("SessionStarted"), F.when(has_segment, "SegmentEntered"), F.when(has_segment, "SegmentCompleted"), F.when(has_segment, "NodeReached"), F.when(completed, "DestinationReached")
    )
    return F.when(state == "CANCELLED", F.array(F.lit("SessionCancelled"))).otherwise(F.array_compact(told))


def session_events(steps: DataFrame, reports: DataFrame, state: Column | None = None) -> DataFrame:
    """(session_id, call_no, place, event_type, node): the events of every call; steps: session_id, call_no, step of route session_id."""
    r = steps.join(reports.withColumnRenamed("route_id", "session_id"), ["session_id", "step"])
    told = events_of(state if state is not None else F.lit("ACTIVE"), F.col("current_segment").isNotNull(), F.col("completed"))
    rows = r.select("session_id", "call_no", "current_node", F.posexplode(told).alias("place", "event_type"))
    return rows.select("session_id", "call_no", F.col("place").cast("long").alias("place"), "event_type", F.when(F.col("event_type").isin("NodeReached", "DestinationReached"), F.col("current_node")).alias("node"))


def event_counts(events: DataFrame, *by: str) -> DataFrame:
    return events.groupBy(*by, "event_type").agg(F.count(F.lit(1)).alias("n"))


def event_audit(events: DataFrame, *by: str) -> DataFrame:
    """(check_name, by, place): unknown types, repeats, types out of order, and a destination without a node."""
    rank = F.array_position(F.array(*map(F.lit, EVENT_ORDER)), F.col("event_type"))
    order = Window.partitionBy(*by).orderBy("place")
    marked = events.withColumn("rank", rank).withColumn("before", F.lag(rank).over(order)).withColumn("nth", F.row_number().over(Window.partitionBy(*by, "event_type").orderBy("place")))
    out = marked.where("rank = 0").select(*violation("unknown_type", *by, "place"))
    out = out.unionByName(marked.where("nth > 1").select(*violation("duplicate", *by, "place")))
    out = out.unionByName(marked.where("rank > 0 AND before > rank").select(*violation("order", *by, "place")))
    return out.unionByName(marked.where("event_type = 'DestinationReached' AND node IS NULL").select(*violation("no_node", *by, "place")))


#: What an event of a type has to carry besides its type.
NEEDED = {"SegmentEntered": ("segment", "node"), "SegmentCompleted": ("segment", "node"), "NodeReached": ("node",), "FloorChanged": ("node",), "DestinationReached": ("node",)}


def batch_audit(events: DataFrame, batches: DataFrame, *by: str) -> DataFrame:
    """(check_name, by, place): which of nine rules the batches of events break; place is null for rules over a whole batch.

    events: by, place, event_type, segment, node; batches: by, state, completed.  Of an event:
    unsupported_type; duplicate_type, a type told before in the batch; missing_field; order,
    the event before comes later in EVENT_ORDER, unsupported ones come first.  Of a batch:
    destination_not_completed; floor_changed, which nothing can tell; completed_without_entered
    and node_without_entered, if no SegmentEntered stands before the first of them;
    cancelled_state, a cancelled event of a session that is not.  Events of equal place are
    taken in the order of their types.
    """
    kind = F.col("event_type")
    rank = F.array_position(F.array(*map(F.lit, EVENT_ORDER)), kind)
    order = Window.partitionBy(*by).orderBy("place", "event_type")
    missing = F.lit(False)
    for name, fields in NEEDED.items():
        lacks = F.lit(False)
        for c in fields:
            lacks |= F.col(c).isNull()
        missing |= (kind == name) & lacks
    rows = events.withColumns({"rank": rank, "before": F.lag(rank).over(order), "nth": F.row_number().over(Window.partitionBy(*by, "event_type").orderBy("place")), "at": F.row_number().over(order), "lacks": missing})
    checks = {"unsupported_type": F.coalesce(F.col("rank"), F.lit(0)) == 0, "duplicate_type": F.col("nth") > 1, "missing_field": F.col("lacks"), "order": F.col("before") > F.col("rank")}
    told = F.array_compact(F.array(*(F.when(held, name) for name, held in checks.items())))
    out = rows.select(F.explode(told).alias("check_name"), *by, "place")
    first = {name: F.min(F.when(kind == name, F.col("at"))).alias(name) for name in EVENT_ORDER}
    whole = rows.groupBy(*by).agg(*first.values()).join(batches, list(by), "left")
    late = lambda c: F.col(c).isNotNull() & (F.col("SegmentEntered").isNull() | (F.col(c) < F.col("SegmentEntered")))
    checks = {
        "destination_not_completed": F.col("DestinationReached").isNotNull() & ~F.coalesce("completed", F.lit(False)),
        "floor_changed": F.col("FloorChanged").isNotNull(),
        "completed_without_entered": late("SegmentCompleted"),
        "node_without_entered": late("NodeReached"),
        "cancelled_state": F.col("SessionCancelled").isNotNull() & ~F.coalesce(F.col("state") == "CANCELLED", F.lit(False)),
    }
    told = F.array_compact(F.array(*(F.when(held, name) for name, held in checks.items())))
    return out.unionByName(whole.select(F.explode(told).alias("check_name"), *by, F.lit(None).cast("long").alias("place")))


def batch_reports(faults: DataFrame, events: DataFrame, *by: str) -> DataFrame:
    """(by, valid, n_events, n_errors): one report a batch."""
    n = events.groupBy(*by).agg(F.count(F.lit(1)).alias("n_events"))
    bad = faults.groupBy(*by).agg(F.count(F.lit(1)).alias("n_errors"))
    joined = n.join(bad, list(by), "left").withColumn("n_errors", F.coalesce("n_errors", F.lit(0).cast("long")))
    return joined.withColumn("valid", F.col("n_errors") == 0)
