"""Building, counting and auditing navigation graphs; every function takes many graphs at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwalk.operators.components import connected_components
from planwalk.operators.routing import violation

NODE_TYPES = ("ROOM_ENTRY", "CORRIDOR_INTERSECTION", "DEAD_END", "VERTICAL_CONNECTOR", "BUILDING_ENTRY")


def neighbours(connections: DataFrame, a: str, b: str) -> DataFrame:
    """(node, neighbour): both directions of every connection, repeats kept."""
    there = connections.select(F.col(a).alias("node"), F.col(b).alias("neighbour"))
    return there.unionByName(connections.select(F.col(b).alias("node"), F.col(a).alias("neighbour")))


def candidate_type(category: Column, neighbours_of: Column) -> Column:
    """First rule that fires on a semantic category and the categories around it; a neighbour without category is no room."""
    n = F.size(neighbours_of)
    room = F.exists(neighbours_of, lambda c: F.coalesce(c == "ROOM", F.lit(False)))
    return (
        F.when((category == "DOORWAY") & room, "ROOM_ENTRY")
        .when((category == "CORRIDOR") & (n >= 3), "CORRIDOR_INTERSECTION")
        .when((category == "CORRIDOR") & (n == 1), "DEAD_END")
        .when(category == "VERTICAL_CONNECTOR", "VERTICAL_CONNECTOR")
        .when((category == "DOORWAY") & (n == 1) & ~room, "BUILDING_ENTRY")
    )


def detect_candidates(objects: DataFrame, connections: DataFrame) -> DataFrame:
    """(object_id, candidate_type, n_neighbours) of the objects (object_id, category) that some rule makes a candidate."""
    around = neighbours(connections, "src", "dst").join(objects.select(F.col("object_id").alias("neighbour"), "category"), "neighbour")
    around = around.groupBy(F.col("node").alias("object_id")).agg(F.collect_list(F.coalesce("category", F.lit(""))).alias("around"))
    rows = objects.join(around, "object_id", "left").withColumn("around", F.coalesce("around", F.array().cast("array<string>")))
    rows = rows.select("object_id", candidate_type(F.col("category"), F.col("around")).alias("candidate_type"), F.size("around").cast("long").alias("n_neighbours"))
    return rows.where("candidate_type IS NOT NULL")


def type_counts(rows: DataFrame, column: str, *by: str) -> DataFrame:
    """Number of rows of each type, next to the total."""
    counts = [F.count_if(F.col(column) == t).alias(f"n_{t.lower()}") for t in NODE_TYPES]
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_total"), *counts)


def generate_edges(connections: DataFrame, order: str) -> DataFrame:
    """(graph_id, src, dst, cost): the first connection of every unordered pair as two directed edges of cost 1; loops are dropped."""
    first = Window.partitionBy("graph_id", F.least("src", "dst"), F.greatest("src", "dst")).orderBy(order)
    kept = connections.where("src <> dst").withColumn("rn", F.row_number().over(first)).where("rn = 1")
    both = F.inline(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b"))))
    return kept.select("graph_id", both).select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst"), F.lit(1.0).alias("cost"))


def degree_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per graph: nodes, edges, average out-degree and nodes without a way out."""
    degree = edges.groupBy("graph_id", F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("degree"))
    d = F.coalesce("degree", F.lit(0))
    return nodes.join(degree, ["graph_id", "node_id"], "left").groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(d).alias("n_edges"), F.avg(d).alias("avg_degree"), F.count_if(d == 0).alias("n_isolated"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node_id, component): component is the smallest node id that can be reached with edges taken both ways."""
    key = lambda c: F.concat_ws("/", "graph_id", c)
    labels = connected_components(edges.select(key("src").alias("a"), key("dst").alias("b")))
    named = nodes.withColumn("node", key("node_id")).join(labels, "node", "left")
    return named.select("graph_id", "node_id", F.coalesce(F.expr("substring(label, length(graph_id) + 2)"), "node_id").alias("component"))


def structure_audit(nodes: DataFrame, edges: DataFrame, order: str) -> DataFrame:
    """(check_name, graph_id, order): ends that are no node, loops, and every repeat of a directed edge after the first."""
    out = None
    for name, end in (("orphan_source", "src"), ("orphan_target", "dst")):
        found = edges.join(nodes.select("graph_id", F.col("node_id").alias(end)), ["graph_id", end], "left_anti").select(*violation(name, "graph_id", order))
        out = found if out is None else out.unionByName(found)
    out = out.unionByName(edges.where("src = dst").select(*violation("self_loop", "graph_id", order)))
    again = edges.withColumn("rn", F.row_number().over(Window.partitionBy("graph_id", "src", "dst").orderBy(order))).where("rn > 1")
    return out.unionByName(again.select(*violation("duplicate", "graph_id", order)))


def validation_status(nodes: DataFrame, edges: DataFrame, violations: DataFrame) -> DataFrame:
    """Per graph: n_errors, n_components, n_isolated, validation and the status that publication gives it."""
    parts = components(nodes, edges).groupBy("graph_id").agg(F.countDistinct("component").alias("n_components"))
    errors = violations.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_errors"))
    rows = degree_statistics(nodes, edges).join(parts, "graph_id").join(errors, "graph_id", "left").withColumn("n_errors", F.coalesce("n_errors", F.lit(0)))
    state = F.when(F.col("n_errors") > 0, "INVALID").when((F.col("n_isolated") > 0) | (F.col("n_components") > 1), "VALID_WITH_WARNINGS").otherwise("VALID")
    return rows.select("graph_id", "n_errors", "n_components", "n_isolated", state.alias("validation"), F.when(state == "INVALID", "FAILED").otherwise("READY").alias("status"))
