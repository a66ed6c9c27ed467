"""Searches over corridors, paths by doubled pointers, and routes under policies, against plain loops."""

import heapq
import random
import time

from pyspark.sql import functions as F

from planwalk.operators import routing


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "graph_id string, src string, dst string, cost double")


def origins_of(spark, *rows):
    return spark.createDataFrame(list(rows), "graph_id string, origin string")


def heap_costs(rows, origin):
    best, heap = {}, [(0.0, origin)]
    while heap:
        d, n = heapq.heappop(heap)
        if n not in best:
            best[n] = d
            for a, b, c in rows:
                if a == n and c is not None and b not in best:
                    heapq.heappush(heap, (d + c, b))
    return best


def test_a_corridor_is_one_hop(spark):
    n = 1000
    rows = [("G", f"n{k:04d}", f"n{k + 1:04d}", float(1 + k % 3)) for k in range(n)] + [("G", f"n{k + 1:04d}", f"n{k:04d}", 2.0) for k in range(n)]
    began = time.time()
    origin = origins_of(spark, ("G", "n0000"))
    tree = routing.shortest_tree(edges_of(spark, rows), origin)
    found = routing.paths(tree, spark.createDataFrame([("G", "n0000", f"n{n:04d}"), ("G", "n0000", "n0003")], "graph_id string, origin string, destination string")).collect()
    assert time.time() - began < 60
    by = {r["destination"]: r for r in found}
    assert by[f"n{n:04d}"]["path"] == [f"n{k:04d}" for k in range(n + 1)] and by[f"n{n:04d}"]["total_cost"] == sum(1 + k % 3 for k in range(n))
    assert by["n0003"]["path"] == ["n0000", "n0001", "n0002", "n0003"]


def test_chains_dead_ends_and_rings_equal_a_heap_search(spark):
    rng = random.Random(8)
    rows, wanted, origins = [], {}, []
    for graph in range(12):
        own, names = [], iter(range(10_000))
        hubs = [f"h{k}" for k in range(rng.randint(1, 5))]
        for _ in range(rng.randint(2, 9)):
            a, b = rng.choice(hubs), rng.choice([*hubs, None])
            chain = [a, *(f"c{next(names)}" for _ in range(rng.randint(0, 12))), *([b] if b else [])]
            for x, y in zip(chain, chain[1:], strict=False):
                for s, t in ((x, y), (y, x)):
                    if rng.random() < 0.85:
                        own.append((s, t, float(rng.randint(1, 9))))
        ring = [f"r{k}" for k in range(7)]
        own += [(x, y, 1.0) for x, y in zip(ring, ring[1:] + ring[:1], strict=True)]
        own += [("h0", "h0", 1.0), ("h0", "c0", None), *rng.sample(own, 2)]
        starts = {"h0", rng.choice(own)[0]}
        rows += [(f"G{graph}", *e) for e in own]
        for s in starts:
            origins.append((f"G{graph}", s))
            wanted |= {(f"G{graph}", s, n): d for n, d in heap_costs(own, s).items()}
    got = {(r["graph_id"], r["origin"], r["node_id"]): r["cost"] for r in routing.shortest_costs(edges_of(spark, rows), origins_of(spark, *origins)).collect()}
    assert got == wanted
    tree = routing.shortest_tree(edges_of(spark, rows), origins_of(spark, *origins))
    ends = tree.select("graph_id", "origin", F.col("node_id").alias("destination"))
    price = {}
    for g, a, b, c in rows:
        if c is not None:
            price[g, a, b] = min(c, price.get((g, a, b), c))
    found = routing.paths(tree, ends).collect()
    assert len(found) == len(wanted)
    for r in found:
        hops = list(zip(r["path"], r["path"][1:], strict=False))
        assert r["path"][0] == r["origin"] and r["path"][-1] == r["destination"] and sum(price[r["graph_id"], a, b] for a, b in hops) == wanted[r["graph_id"], r["origin"], r["destination"]]


def test_rounding_along_chains_loses_no_predecessor(spark):
    rows = [("G", f"n{k}", f"n{k + 1}", 0.1 * (k + 1)) for k in range(40)] + [("G", "n40", "n0", 0.7)]
    tree = routing.shortest_tree(edges_of(spark, rows), origins_of(spark, ("G", "n0")))
    assert {r["node_id"]: r["predecessor"] for r in tree.collect()} == {"n0": None} | {f"n{k + 1}": f"n{k}" for k in range(40)}


def test_routes_differ_by_policy(spark):
    edges = edges_of(spark, [("G", "A", "S", 1.0), ("G", "S", "D", 1.0), ("G", "A", "R", 2.0), ("G", "R", "D", 2.0), ("H", "A", "D", 1.0)])
    contexts = spark.createDataFrame([("G", 4, "AVOID"), ("G", 2, "SHORTEST"), ("G", 9, "NO_STAIRS"), ("G", 7, "AVOID"), ("H", 1, "SHORTEST"), ("H", 3, "CLOSED")], "graph_id string, context_id int, preference string")
    asked = spark.createDataFrame([("G", "A", "D"), ("H", "A", "D")], "graph_id string, origin string, destination string")
    stairs = (F.col("src") == "S") | (F.col("dst") == "S")
    policies = {"AVOID": F.when(stairs, F.col("cost") + 5).otherwise(F.col("cost")), "NO_STAIRS": F.when(~stairs, F.col("cost")), "CLOSED": F.lit(None).cast("double")}
    found = routing.preference_routes(edges, contexts, asked, policies)
    got = sorted((r["graph_id"], r["place"], r["context_id"], "".join(r["path"]), r["total_cost"], r["hop_count"]) for r in found.collect())
    assert got == [("G", 1, 2, "ASD", 2.0, 2), ("G", 2, 4, "ARD", 4.0, 2), ("G", 3, 7, "ARD", 4.0, 2), ("G", 4, 9, "ARD", 4.0, 2), ("H", 1, 1, "AD", 1.0, 1)]
    of = {r["graph_id"]: r for r in routing.comparison_summary(found).collect()}
    assert (of["G"]["n_routes"], of["G"]["n_preferences"], of["G"]["n_ways"], of["G"]["min_cost"]) == (4, 3, 2, 2.0)
