"""Shortest paths, routes and their audits over tables of nodes and directed weighted edges.

Every function takes many graphs at once: `keys` are the columns that tell them apart.
Costs are positive.  The predecessor of a node is the smallest id among those on a cheapest
way to it, so each route is unique.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwalk.sources.scratch import written

TOLERANCE = 1e-9
#: Edges of a graph, or nodes of a tree, up to which one task takes it; larger ones go round by round over all tasks.
WITHIN = 2_097_152
#: Origins from which one task searches a graph; from more, several tasks do.
TOGETHER = 64
#: Rows of a batch that a task returns.
ROWS = 65_536


def _numbers(batches: list[pa.RecordBatch], *columns: str) -> tuple[pa.Array, list[np.ndarray]]:
    """The values of all columns in ascending order, and each column as places among them, -1 for null."""
    told = [pa.chunked_array([b.column(c) for b in batches]) for c in columns]
    ids = pc.unique(pa.chunked_array([x for t in told for x in t.chunks])).drop_null()
    ids = ids.take(pc.sort_indices(ids))
    return ids, [pc.fill_null(pc.index_in(t, ids), -1).to_numpy() for t in told]


def _column(batches: list[pa.RecordBatch], name: str) -> np.ndarray:
    return np.concatenate([b.column(name).to_numpy(zero_copy_only=False) for b in batches])


def _cheapest(first: np.ndarray, to: np.ndarray, w: np.ndarray, start: int) -> np.ndarray:
    """Cost of each node from the start, infinite out of reach; the edges of node v are those from first[v] on."""
    best = np.full(len(first) - 1, np.inf)
    best[start] = 0.0
    frontier = np.array([start])
    while len(frontier):
        n = first[frontier + 1] - first[frontier]
        e = np.repeat(first[frontier] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        new, ends = np.repeat(best[frontier], n) + w[e], to[e]
        better = new < best[ends]
        np.minimum.at(best, ends[better], new[better])
        frontier = np.unique(ends[better])
    return best


def _blocks(steps: DataFrame, origins: DataFrame, k: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both with a block: a graph's origins are dealt to blocks of TOGETHER or so, and each block has the graph's edges."""
    n = origins.groupBy(*k).agg(F.ceil(F.count(F.lit(1)) / TOGETHER).cast("int").alias("n_blocks"))
    own = origins.join(n, k).withColumn("block", F.pmod(F.xxhash64("origin"), F.col("n_blocks")).cast("int")).drop("n_blocks")
    return steps.join(n, k).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).drop("n_blocks"), own


def _within(steps: DataFrame, origins: DataFrame, k: list[str]) -> DataFrame:
    """(keys, origin, node_id, cost, predecessor): each graph and block of origins is searched by one task, over numbered nodes."""
    kinds = dict(steps.dtypes)
    asked = origins.select(*k, "block", F.col("origin").alias("src"), F.lit(None).cast(kinds["dst"]).alias("dst"), F.lit(None).cast("double").alias("w"))
    schema = steps.select(*k, F.col("src").alias("origin"), F.col("src").alias("node_id"), F.col("w").alias("cost"), F.col("src").alias("predecessor")).schema

    def search(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = list(batches)
        ids, (src, dst) = _numbers(told, "src", "dst")
        w = _column(told, "w")
        starts, edge = src[dst < 0], dst >= 0
        if not len(starts):
            return
        del told
        src, dst, w = src[edge], dst[edge], w[edge]
        order = np.argsort(src, kind="stable")
        src, dst, w = src[order], dst[order], w[order]
        first = np.searchsorted(src, np.arange(len(ids) + 1))
        for start in starts:
            best = _cheapest(first, dst, w, start)
            before, cost = best[src], best[dst]
            on_way = (before < cost) & (before + w <= cost * (1 + TOLERANCE)) & (dst != start)
            predecessor = np.full(len(ids), len(ids))
            np.minimum.at(predecessor, dst[on_way], src[on_way])
            reached = np.flatnonzero(best < np.inf)
            for at in range(0, len(reached), ROWS):
                some = reached[at : at + ROWS]
                columns = [ids.take(pa.array(np.full(len(some), start))), ids.take(pa.array(some)), pa.array(best[some]), ids.take(pa.array(predecessor[some], mask=predecessor[some] == len(ids)))]
                yield pa.RecordBatch.from_arrays([*(pa.repeat(x, len(some)) for x in key[:-1]), *columns], names=schema.names)

    return steps.select(*k, "block", "src", "dst", "w").unionByName(asked).groupBy(*k, "block").applyInArrow(search, schema)


def _chains(steps: DataFrame, origins: DataFrame, k: list[str]) -> tuple[DataFrame, DataFrame] | None:
    """(passed, ways): the nodes that are passed through, and (keys, node, next, end, back): where it ends to go on from a node by the next one, and what the way from that end back to the node costs; null if no two nodes in a row are passed through.

    A node with at most two neighbours that is no origin is passed through.  Whoever arrives
    at one goes on to its other neighbour; each step points to the one after it, and pointers
    are doubled until all have arrived at a node that is not passed through.  Ways into dead
    ends, and rings without any other node, which are out of reach, have no row.
    """
    both = steps.select(*k, F.col("src").alias("node"), F.col("dst").alias("next")).unionByName(steps.select(*k, F.col("dst").alias("node"), F.col("src").alias("next"))).distinct()
    near = both.groupBy(*k, "node").agg(F.count(F.lit(1)).alias("n"), F.min("next").alias("low"), F.max("next").alias("high"))
    starts = origins.select(*k, F.col("origin").alias("node")).distinct()
    passed = written(near.where("n <= 2").drop("n").join(starts, [*k, "node"], "left_anti"), "passed")
    at = passed.select(*k, F.col("node").alias("next"), "low", "high", F.lit(True).alias("goes_on"))
    marked = both.join(at, [*k, "next"], "left").join(passed.select(*k, "node", F.lit(True).alias("inner")), [*k, "node"], "left")
    if marked.where("goes_on AND inner").isEmpty():
        return None
    other = F.when(F.col("node") == F.col("low"), F.col("high")).otherwise(F.col("low"))
    after = F.when(F.col("goes_on") & (other != F.col("node")), other)
    back = steps.select(*k, F.col("dst").alias("node"), F.col("src").alias("next"), F.col("w").alias("back"))
    ways = marked.where("goes_on OR inner").join(back, [*k, "node", "next"], "left")
    # the step that this one points to is (at, to); the last step of a way has an end instead
    ways = ways.select(*k, "node", "next", F.coalesce("back", F.lit(float("inf"))).alias("back"), F.when(F.col("goes_on").isNull(), F.col("next")).alias("end"), F.when(after.isNotNull(), F.col("next")).alias("at"), after.alias("to"))
    ways = written(ways.where("end IS NOT NULL OR to IS NOT NULL"), "ways")
    moving = ways.where("end IS NULL").count()
    while moving:
        ahead = ways.select(*k, F.col("node").alias("at"), F.col("next").alias("to"), F.col("back").alias("b"), F.col("end").alias("e"), F.col("at").alias("a"), F.col("to").alias("t"))
        # what points into a dead end finds no step there and is gone
        moved = ways.where("end IS NULL").drop("end").join(ahead, [*k, "at", "to"])
        moved = moved.select(*k, "node", "next", (F.col("back") + F.col("b")).alias("back"), F.col("e").alias("end"), F.col("a").alias("at"), F.col("t").alias("to"))
        ways = written(ways.where("end IS NOT NULL").unionByName(moved), "ways")
        left = ways.where("end IS NULL").count()
        if left == moving:
            break  # rings
        moving = left
    return passed.select(*k, "node"), ways.where("end IS NOT NULL AND back < double('infinity')").select(*k, "node", "next", "end", "back")


def _searched(steps: DataFrame, origins: DataFrame, k: list[str]) -> DataFrame:
    """(keys, origin, node_id, cost) over steps (keys, src, dst, w), round by round."""
    best = written(origins.select(*k, "origin", F.col("origin").alias("node_id"), F.lit(0.0).alias("cost")).distinct(), "costs")
    frontier = best
    while True:
        reached = frontier.withColumnRenamed("node_id", "src").join(steps, [*k, "src"])
        reached = reached.groupBy(*k, "origin", F.col("dst").alias("node_id")).agg(F.min(F.col("cost") + F.col("w")).alias("new"))
        better = reached.join(best, [*k, "origin", "node_id"], "left").where("cost IS NULL OR new < cost")
        frontier = written(better.select(*k, "origin", "node_id", F.col("new").alias("cost")), "frontier")
        if frontier.isEmpty():
            return best
        best = written(best.join(frontier, [*k, "origin", "node_id"], "left_anti").unionByName(frontier), "costs")


def _large(rows: DataFrame, k: list[str], most: int) -> DataFrame | None:
    """Keys that more than `most` rows have, a small table; null if there are none."""
    sizes = rows.groupBy(*k).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*k)
    found = written(sizes, "large")
    return None if found.isEmpty() else F.broadcast(found)


def _rounds(steps: DataFrame, origins: DataFrame, k: list[str]) -> DataFrame:
    """(keys, origin, node_id, cost), round by round over all tasks.

    Chains of nodes with two neighbours become single steps before the search and are filled
    in after it, so a corridor is one hop.  Each round of the search extends only what the
    last one improved; rounds end when nothing improves, so their number is that of the steps
    of the longest cheapest path over what is left, plus one.  Costs along a chain are added
    up from its end, which may change their last digit where they are no whole numbers.
    """
    steps = written(steps.groupBy(*k, "src", "dst").agg(F.min("w").alias("w")), "edges")
    found = _chains(steps, origins, k)
    if found is None:
        return _searched(steps, origins, k)
    passed, ways = found
    for end in ("src", "dst"):
        steps = steps.join(passed.withColumnRenamed("node", end), [*k, end], "left_anti")
    # from the end of a way back to a node that is not passed through itself
    through = ways.where("node <> end").join(passed, [*k, "node"], "left_anti").select(*k, F.col("end").alias("src"), F.col("node").alias("dst"), F.col("back").alias("w"))
    core = written(steps.select(*k, "src", "dst", "w").unionByName(through).groupBy(*k, "src", "dst").agg(F.min("w").alias("w")), "core")
    costs = _searched(core, origins, k)
    inner = ways.join(passed, [*k, "node"], "left_semi").join(costs.withColumnRenamed("node_id", "end"), [*k, "end"])
    filled = inner.groupBy(*k, "origin", F.col("node").alias("node_id")).agg(F.min(F.col("cost") + F.col("back")).alias("cost"))
    return written(costs.unionByName(filled), "costs")


def _tree(steps: DataFrame, origins: DataFrame, k: list[str]) -> DataFrame:
    """(keys, origin, node_id, cost, predecessor), round by round over all tasks."""
    cost = _rounds(steps, origins, k)
    before = cost.select(*k, "origin", F.col("node_id").alias("src"), F.col("cost").alias("d"))
    ways = before.join(steps.select(*k, "src", F.col("dst").alias("node_id"), "w"), [*k, "src"])
    ways = ways.join(cost, [*k, "origin", "node_id"]).where(f"node_id <> origin AND d < cost AND d + w <= cost * (1 + {TOLERANCE})")
    first = ways.groupBy(*k, "origin", "node_id").agg(F.min("src").alias("predecessor"))
    return cost.join(first, [*k, "origin", "node_id"], "left").select(*k, "origin", "node_id", "cost", "predecessor")


def _split_search(edges: DataFrame, origins: DataFrame, k: list[str], rounds) -> DataFrame:
    """(keys, origin, node_id, cost, predecessor); `rounds` searches the graphs of more than WITHIN edges."""
    # an edge without a finite cost is closed
    steps = written(edges.where("src <> dst AND cost < double('infinity')").dropna(subset=k).select(*k, "src", "dst", F.col("cost").cast("double").alias("w")), "edges")
    starts = written(origins.select(*k, "origin").where("origin IS NOT NULL").distinct(), "origins")
    large = _large(steps, k, WITHIN)
    small_steps, small_starts = (steps, starts) if large is None else (steps.join(large, k, "left_anti"), starts.join(large, k, "left_anti"))
    if _large(starts, k, TOGETHER) is None:
        small_steps, small_starts = small_steps.withColumn("block", F.lit(0)), small_starts.withColumn("block", F.lit(0))
    else:
        small_steps, small_starts = _blocks(small_steps, small_starts, k)
    found = _within(small_steps, small_starts, k)
    if large is not None:
        found = found.unionByName(rounds(steps.join(large, k, "left_semi"), starts.join(large, k, "left_semi"), k))
    return written(found, "tree")


def shortest_costs(edges: DataFrame, origins: DataFrame, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """(keys, origin, node_id, cost) of every node reachable from an origin; edges: keys, src, dst, cost.

    A graph of up to WITHIN edges is searched by one task, any larger one round by round over
    all tasks; both ways give the same costs.
    """
    k = list(keys)
    rounds = lambda s, o, names: _rounds(s, o, names).withColumn("predecessor", F.lit(None).cast(dict(s.dtypes)["src"]))
    return _split_search(edges, origins, k, rounds).drop("predecessor")


def shortest_tree(edges: DataFrame, origins: DataFrame, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """(keys, origin, node_id, cost, predecessor): null for the origin itself.

    Ways that differ by rounding alone, less than TOLERANCE of the cost, count as equal.
    """
    return _split_search(edges, origins, list(keys), _tree)


def _followed(tree: DataFrame, asked: DataFrame, k: list[str]) -> DataFrame:
    """What path_nodes returns, each tree followed by one task."""
    kind = dict(tree.dtypes)["node_id"]
    rows = tree.select(*k, "node_id", "predecessor", "cost", F.lit(False).alias("asked"))
    rows = rows.unionByName(asked.select(*k, F.col("destination").alias("node_id"), F.lit(None).cast(kind).alias("predecessor"), F.lit(None).cast("double").alias("cost"), F.lit(True).alias("asked")))
    schema = tree.select(*k, F.col("node_id").alias("destination"), F.col("cost").alias("total_cost"), F.lit(0).cast("long").alias("left"), F.col("node_id").alias("node")).schema

    def follow(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told = list(batches)
        is_asked = _column(told, "asked").astype(bool)
        if not is_asked.any():
            return
        ids, (node, before) = _numbers(told, "node_id", "predecessor")
        up, cost = np.full(len(ids), -1), np.full(len(ids), np.nan)
        known = ~is_asked & (node >= 0)
        up[node[known]], cost[node[known]] = before[known], _column(told, "cost")[known]
        there = np.unique(node[is_asked & (node >= 0)])
        there = there[~np.isnan(cost[there])]
        for start in range(0, len(there), ROWS):
            destination = now = there[start : start + ROWS]
            rows, waiting, left = [], 0, 0
            while len(now):
                rows.append((destination, np.full(len(now), left), now))
                waiting += len(now)
                further = up[now] >= 0
                destination, now, left = destination[further], up[now][further], left + 1
                if waiting >= ROWS or not len(now):
                    d, n, v = (np.concatenate(x) for x in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([*(pa.repeat(x, len(d)) for x in key), ids.take(pa.array(d)), pa.array(cost[d]), pa.array(n), ids.take(pa.array(v))], names=schema.names)
                    rows, waiting = [], 0

    return rows.groupBy(*k).applyInArrow(follow, schema)


def _doubled(tree: DataFrame, destinations: DataFrame, k: list[str]) -> DataFrame:
    """What path_nodes returns, by pointers to the predecessor that are doubled: each round adds, to the nodes found, those that lie as far before them again, so a path of n hops takes log2(n) rounds."""
    cost = tree.select(*k, F.col("node_id").alias("destination"), F.col("cost").alias("total_cost"))
    asked = destinations.join(cost, [*k, "destination"])
    found = written(asked.select("*", F.lit(0).cast("long").alias("left"), F.col("destination").alias("node")), "path-nodes")
    up = tree.where("predecessor IS NOT NULL").select(*k, F.col("node_id").alias("node"), F.col("predecessor").alias("to"))
    far = 1
    while True:
        further = found.join(up, [*k, "node"]).select(*k, "destination", "total_cost", (F.col("left") + far).alias("left"), F.col("to").alias("node"))
        further = written(further, "further")
        if further.isEmpty():
            return found
        found = written(found.unionByName(further), "path-nodes")
        up = written(up.join(up.select(*k, F.col("node").alias("to"), F.col("to").alias("then")), [*k, "to"]).select(*k, "node", F.col("then").alias("to")), "pointers")
        far *= 2


def path_nodes(tree: DataFrame, destinations: DataFrame, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """(keys, origin, destination, total_cost, left, node): every node of the path to each destination, with the number of hops left to it.

    A tree of up to WITHIN nodes is followed by one task, a larger one by doubled pointers
    over all tasks.  Destinations out of reach have no row.
    """
    k = [*keys, "origin"]
    asked = destinations.select(*k, "destination").dropna().distinct()
    large = _large(tree, k, WITHIN)
    if large is None:
        return written(_followed(tree, asked, k), "path-nodes")
    small = _followed(tree.join(large, k, "left_anti"), asked.join(large, k, "left_anti"), k)
    return written(small.unionByName(_doubled(written(tree.join(large, k, "left_semi"), "tree"), asked.join(large, k, "left_semi"), k)), "path-nodes")


def paths(tree: DataFrame, destinations: DataFrame, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """(keys, origin, destination, total_cost, path): path holds the node ids from origin to destination; unreachable ones have no row."""
    nodes = path_nodes(tree, destinations, keys)
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("at"), "node")))
    return nodes.groupBy(*keys, "origin", "destination", "total_cost").agg(F.transform(ordered, lambda s: s["node"]).alias("path"))


def route_segments(found: DataFrame) -> DataFrame:
    """Hops of each path, numbered from 1, as (other columns, sequence, source_node, target_node)."""
    rest = [c for c in found.columns if c != "path"]
    hops = F.expr("CASE WHEN size(path) > 1 THEN transform(sequence(1, size(path) - 1), i -> struct(i AS sequence, path[i - 1] AS source_node, path[i] AS target_node)) ELSE array() END")
    return found.select(*rest, F.inline(hops))


def route_statistics(found: DataFrame) -> DataFrame:
    """total_segments beside total_cost, for each path."""
    return found.withColumn("total_segments", F.size("path") - 1)


def violation(name: str, *columns: Column | str):
    return F.lit(name).alias("check_name"), *columns


def path_audit(found: DataFrame, nodes: DataFrame, edges: DataFrame, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """(check_name, keys, origin, destination): ends that differ, nodes or edges that do not exist, a stated cost that is no sum of its edges."""
    k = [*keys, "origin", "destination"]
    ends = found.where((F.element_at("path", 1) != F.col("origin")) | (F.element_at("path", -1) != F.col("destination")))
    on_path = found.select(*k, F.explode("path").alias("node_id"))
    strange = on_path.join(nodes.select(*keys, "node_id"), [*keys, "node_id"], "left_anti").select(k).distinct()
    hops = route_segments(found).join(edges.select(*keys, F.col("src").alias("source_node"), F.col("dst").alias("target_node"), "cost"), [*keys, "source_node", "target_node"], "left")
    summed = hops.groupBy(*k, "total_cost").agg(F.sum("cost").alias("cost"), F.count_if(F.col("cost").isNull()).alias("missing"))
    out = ends.select(*violation("endpoints", *k)).unionByName(strange.select(*violation("unknown_node", *k)))
    out = out.unionByName(summed.where("missing > 0").select(*violation("missing_edge", *k)))
    return out.unionByName(summed.where(f"missing = 0 AND abs(cost - total_cost) > {TOLERANCE}").select(*violation("cost_sum", *k)))


def chain_audit(segments: DataFrame, route: str = "route_id") -> DataFrame:
    """(check_name, route, sequence): gaps and repeats in the numbering from 1, and hops that do not start where the one before ended."""
    order = Window.partitionBy(route).orderBy("sequence", "target")
    marked = segments.select(route, "sequence", "source", "target", F.row_number().over(order).alias("place"), F.lag("target").over(order).alias("reached"), F.lag("sequence").over(order).alias("last"))
    out = marked.where("sequence <> place").select(*violation("sequence_gap", route, "sequence"))
    out = out.unionByName(marked.where("sequence = last").select(*violation("duplicate_sequence", route, "sequence")))
    out = out.unionByName(marked.where("reached IS NOT NULL AND reached <> source").select(*violation("broken_chain", route, "sequence")))
    return out.unionByName(marked.where("source = target").select(*violation("self_loop", route, "sequence")))


def route_status(violations: DataFrame, routes: DataFrame, route: str = "route_id") -> DataFrame:
    """READY for routes without violations, FAILED for the others."""
    bad = violations.groupBy(route).agg(F.count(F.lit(1)).alias("n_errors"))
    return routes.select(route).join(bad, route, "left").select(route, F.coalesce("n_errors", F.lit(0)).alias("n_errors"), F.when(F.col("n_errors") > 0, "FAILED").otherwise("READY").alias("status"))


def effective_costs(edges: DataFrame, contexts: DataFrame, policies: dict[str, Column] | None = None) -> DataFrame:
    """Every edge under every routing context of its graph (graph_id, context_id, preference); a preference without a policy keeps the base cost."""
    cost = F.col("cost")
    effective = cost
    for preference, policy in (policies or {}).items():
        effective = F.when(F.col("preference") == preference, policy).otherwise(effective)
    named = [c for c in ("edge_id",) if c in edges.columns]
    return edges.join(contexts, "graph_id").select("graph_id", "context_id", "preference", *named, "src", "dst", cost.alias("base_cost"), effective.alias("cost"))


def cost_summary(edges: DataFrame, *by: str) -> DataFrame:
    return edges.groupBy(*by).agg(F.count(F.lit(1)).alias("n_edges"), F.min("cost").alias("min_cost"), F.max("cost").alias("max_cost"), F.avg("cost").alias("avg_cost"))


def constant_costs(edges: DataFrame, cost: float = 1.0) -> DataFrame:
    """All edges at one traversal cost."""
    return edges.withColumn("cost", F.lit(cost))


def cost_audit(edges: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """(check_name, key): costs that are missing, not finite or not positive, and edges that are in one table only."""
    cost = F.col("cost")
    out = edges.where(cost.isNull() | F.isnan(cost)).select(*violation("not_a_number", key))
    out = out.unionByName(edges.where(F.abs(cost) == float("inf")).select(*violation("infinite", key)))
    out = out.unionByName(edges.where(cost <= 0).select(*violation("not_positive", key)))
    out = out.unionByName(edges.join(known.select(key), key, "left_anti").select(*violation("unknown_edge", key)))
    return out.unionByName(known.join(edges.select(key), key, "left_anti").select(*violation("unprocessed_edge", key)))


def policy_of(policies: dict[str, Column]) -> Column:
    """What tells apart preferences whose costs differ: those without a policy share one."""
    return F.when(F.col("preference").isin(*policies), F.concat(F.lit("by "), "preference")).otherwise("base") if policies else F.lit("base")


def policy_costs(edges: DataFrame, contexts: DataFrame, policies: dict[str, Column]) -> DataFrame:
    """(graph_id, policy, src, dst, cost): every edge under each different policy of its graph's contexts, with policy as policy_of tells it."""
    kinds = contexts.where("preference IS NOT NULL").withColumn("policy", policy_of(policies)).groupBy("graph_id", "policy").agg(F.min("preference").alias("preference"))
    priced = effective_costs(edges, kinds.withColumn("context_id", F.lit(None).cast("int")), policies)
    return priced.select("graph_id", policy_of(policies).alias("policy"), "src", "dst", "cost")


def preference_routes(edges: DataFrame, contexts: DataFrame, asked: DataFrame, policies: dict[str, Column]) -> DataFrame:
    """(graph_id, context_id, place, preference, origin, destination, total_cost, hop_count, path): the cheapest route of every context of a graph over the costs that its preference's policy gives.

    contexts: graph_id, context_id, preference; asked: graph_id, origin, destination.  place
    counts a reply's routes in the order of context_id; a context under which the destination
    is out of reach is left out.  Contexts of one policy share one search.
    """
    k = ("graph_id", "policy")
    wanted = contexts.where("preference IS NOT NULL").withColumn("policy", policy_of(policies)).join(asked, "graph_id")
    tree = shortest_tree(policy_costs(edges, contexts, policies), wanted.select(*k, "origin"), k)
    found = paths(tree, wanted.select(*k, "origin", "destination"), k).withColumn("hop_count", (F.size("path") - 1).cast("long"))
    reply = Window.partitionBy("graph_id", "origin", "destination").orderBy("context_id")
    found = wanted.join(found, [*k, "origin", "destination"]).withColumn("place", F.row_number().over(reply))
    return found.select("graph_id", "context_id", "place", "preference", "origin", "destination", "total_cost", "hop_count", "path")


def comparison_summary(found: DataFrame) -> DataFrame:
    """Per graph: routes found, distinct preferences, different ways, least and average cost and average hops."""
    return found.groupBy("graph_id").agg(
        F.count(F.lit(1)).alias("n_routes"), F.countDistinct("preference").alias("n_preferences"), F.countDistinct("path").alias("n_ways"), F.min("total_cost").alias("min_cost"), F.avg("total_cost").alias("avg_cost"), F.avg(F.size("path") - 1).alias("avg_hops")
    )


def request_status(requests: DataFrame, graphs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Status code of routing requests (graph_id, origin, destination), the first failing condition in this order: 404 no graph, 409 graph not READY, 400 missing, equal or unknown ends."""
    n = nodes.select("graph_id", "node_id")
    r = requests.join(graphs.select("graph_id", "status"), "graph_id", "left")
    for x in ("origin", "destination"):
        r = r.join(n.select("graph_id", F.col("node_id").alias(x), F.lit(True).alias(f"has_{x}")), ["graph_id", x], "left")
    code = (
        F.when(F.col("status").isNull(), 404)
        .when(F.col("status") != "READY", 409)
        .when(F.col("origin").isNull() | F.col("destination").isNull() | (F.col("origin") == F.col("destination")), 400)
        .when(F.col("has_origin").isNull() | F.col("has_destination").isNull(), 400)
        .otherwise(200)
    )
    return r.select(*requests.columns, code.alias("status_code"))
