"""Components over all edges, and lists over all graphs, against plain loops."""

from planwalk.plans import graph_queries, session_queries
from planwalk.plans.views import view

SF = "/root/testdata/sf0.001"


def test_components_take_all_edges(spark):
    lowest = {(r["graph_id"], r["node_id"]): r["node_id"] for r in view(spark, SF, "f_nodes").collect()}
    edges = [(r["graph_id"], r["src"], r["dst"]) for r in view(spark, SF, "f_edges").collect()]
    changed = True
    while changed:
        changed = False
        for g, a, b in edges:
            low = min(lowest[g, a], lowest[g, b])
            for node in (a, b):
                if lowest[g, node] != low:
                    lowest[g, node], changed = low, True
    found = {(r["graph_id"], r["node_id"]): r["component"] for r in graph_queries.graph_components_all(spark, SF).collect()}
    assert found == lowest


def test_list_of_all_graphs_is_in_order(spark):
    wanted = sorted(r["event_id"] for r in view(spark, SF, "events").where("event_type = 'view'").collect())
    assert [r["event_id"] for r in session_queries.filtered_list_all(spark, SF).collect()] == wanted
    part = [r["event_id"] for r in session_queries.filtered_list(spark, SF).collect()]
    assert part == [e for e in wanted if e % 12 == 2]
