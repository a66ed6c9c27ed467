"""Searches by one task and round by round give the same costs, trees and paths, and take few jobs however long the ways are."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401
from planwalk import registry
from planwalk.operators import routing

EDGES = "graph_id string, src string, dst string, cost double"


def heap_costs(rows, origin):
    best, heap = {}, [(0.0, origin)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in best:
            best[n] = d
            for a, b, c in rows:
                if a == n and a != b and c is not None and c < float("inf") and b not in best:
                    heapq.heappush(heap, (d + c, b))
    return best


def mesh(rng, n, m):
    """Edges with repeats, loops, closed ones and equal ways."""
    names = [f"n{k:03d}" for k in range(n)]
    rows = [(rng.choice(names), rng.choice(names), rng.choice([1.0, 2.0, 3.0, 7.0, None, float("inf")])) for _ in range(m)]
    return rows + rows[:3]


@pytest.mark.parametrize("within, together", [(routing.WITHIN, 64), (routing.WITHIN, 2), (60, 2), (0, 64)])
def test_both_ways_equal_a_heap(spark, monkeypatch, within, together):
    monkeypatch.setattr(routing, "WITHIN", within)
    monkeypatch.setattr(routing, "TOGETHER", together)
    rng = random.Random(3)
    rows, origins, wanted, parents = [], [], {}, {}
    for g, (n, m) in {"A": (30, 50), "B": (30, 120), "C": (4, 6)}.items():
        own = mesh(rng, n, m)
        rows += [(g, *e) for e in own]
        for o in [f"n{k:03d}" for k in range(0, n, 5)] + ["nowhere"]:
            origins.append((g, o))
            cost = heap_costs(own, o)
            wanted |= {(g, o, v): d for v, d in cost.items()}
            for v, d in cost.items():
                before = [a for a, b, c in own if b == v and a != b and c is not None and a in cost and cost[a] + c == d < float("inf")]
                parents[g, o, v] = min(before) if before and v != o else None
    edges = spark.createDataFrame(rows + [(None, "a", "b", 1.0)], EDGES)
    starts = spark.createDataFrame(origins + origins[:2], "graph_id string, origin string")
    got = {(r["graph_id"], r["origin"], r["node_id"]): r["cost"] for r in routing.shortest_costs(edges, starts).collect()}
    assert got == wanted
    tree = routing.shortest_tree(edges, starts)
    found = tree.collect()
    assert len(found) == len(wanted) and {(r["graph_id"], r["origin"], r["node_id"]): r["cost"] for r in found} == wanted
    assert {(r["graph_id"], r["origin"], r["node_id"]): r["predecessor"] for r in found} == parents
    monkeypatch.setattr(routing, "WITHIN", min(within, 15))
    ends = tree.select("graph_id", "origin", F.col("node_id").alias("destination")).unionByName(spark.createDataFrame([("A", "n000", "far")], "graph_id string, origin string, destination string"))
    ways = routing.paths(tree, ends).collect()
    assert len(ways) == len(wanted)
    for r in ways:
        way, at = [], r["destination"]
        while at is not None:
            way.insert(0, at)
            at = parents[r["graph_id"], r["origin"], at]
        assert r["path"] == way and r["total_cost"] == wanted[r["graph_id"], r["origin"], r["destination"]]


def test_many_paths_come_in_batches(spark, monkeypatch):
    monkeypatch.setattr(routing, "ROWS", 7)
    rows = [("G", f"n{k:02d}", f"n{k + 1:02d}", 1.0) for k in range(30)]
    tree = routing.shortest_tree(spark.createDataFrame(rows, EDGES), spark.createDataFrame([("G", "n00")], "graph_id string, origin string"))
    assert tree.count() == 31
    nodes = routing.path_nodes(tree, tree.select("graph_id", "origin", F.col("node_id").alias("destination"))).collect()
    assert sorted((r["destination"], r["left"], r["node"]) for r in nodes) == sorted((f"n{d:02d}", d - k, f"n{k:02d}") for d in range(31) for k in range(d + 1))


def test_jobs_do_not_grow_with_the_hops(spark):
    """Routes under five preferences through a grid of 24 steps took a job or more a step and preference's search before."""
    edges = []
    for x in range(13):
        for y in range(13):
            for to in ((x + 1, y), (x, y + 1)):
                if max(to) < 13:
                    edges += [("G", f"{x:02d}{y:02d}", "{:02d}{:02d}".format(*to), float(1 + (x * 7 + y * 3) % 5))]
    contexts = spark.createDataFrame([("G", k, p) for k, p in enumerate(("SHORTEST", "FASTEST", "ACCESSIBLE", "AVOID", "OTHER"))], "graph_id string, context_id int, preference string")
    asked = spark.createDataFrame([("G", "0000", "1212")], "graph_id string, origin string, destination string")
    policies = {"ACCESSIBLE": F.col("cost") * 2, "AVOID": F.when(F.col("dst").endswith("06"), F.col("cost") + 9).otherwise(F.col("cost"))}
    spark.sparkContext.setJobGroup("grid", "routes over a grid")
    try:
        found = {r["preference"]: r for r in routing.preference_routes(spark.createDataFrame(edges, EDGES), contexts, asked, policies).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("grid"))
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert found["FASTEST"]["path"] == found["SHORTEST"]["path"] == found["OTHER"]["path"] and found["ACCESSIBLE"]["total_cost"] == 2 * found["SHORTEST"]["total_cost"]
    assert {r["hop_count"] for r in found.values()} == {24}
    assert jobs < 60


def test_preferences_without_a_policy_share_one_search(spark):
    edges = spark.createDataFrame([("G", "a", "b", 1.0)], EDGES)
    contexts = spark.createDataFrame([("G", 1, "SHORTEST"), ("G", 2, "FASTEST"), ("G", 3, "DOUBLE"), ("G", 4, None)], "graph_id string, context_id int, preference string")
    rows = routing.policy_costs(edges, contexts, {"DOUBLE": F.col("cost") * 2}).collect()
    assert sorted((r["policy"], r["cost"]) for r in rows) == [("base", 1.0), ("by DOUBLE", 2.0)]


@pytest.mark.parametrize("name", ["policy_costs", "route_comparison"])
def test_queries_take_few_jobs(spark, name):
    """Each round of a search took several jobs before, and each of five preferences went through all of them."""
    spark.sparkContext.setJobGroup(name, name)
    try:
        found = registry.QUERIES[name](spark, "/root/testdata/sf0.001").collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setJobGroup("", "")
    assert found
    assert jobs < 70
