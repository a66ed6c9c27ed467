"""Queries over spatial objects, semantics, imports and master data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planwalk.functions import geometry as g
from planwalk.operators import graphs, objects, tables
from planwalk.plans.views import oracle, view
from planwalk.registry import register

_TYPED = """typed AS (SELECT r.ord, r.src, r.dst, a.spatial_category AS ca, b.spatial_category AS cb, candidate_type AS t FROM f_rel r JOIN f_objects a ON a.uso_id = r.src JOIN f_objects b ON b.uso_id = r.dst),
rel AS (SELECT DISTINCT CASE WHEN t IN ('CONTAINS', 'TOUCHES') AND ca = 'WALL' AND cb = 'BOUNDARY' THEN dst ELSE src END AS src, CASE WHEN t IN ('CONTAINS', 'TOUCHES') AND ca = 'WALL' AND cb = 'BOUNDARY' THEN src ELSE dst END AS dst,
  CASE WHEN t = 'ADJACENT' THEN 'ADJACENT_TO' WHEN t = 'INTERSECTS' THEN 'INTERSECTS' WHEN (ca = 'BOUNDARY' AND cb = 'WALL') OR (ca = 'WALL' AND cb = 'BOUNDARY') THEN 'BOUNDED_BY' WHEN t = 'CONTAINS' THEN 'CONTAINS'
    WHEN ca NOT IN ('BOUNDARY', 'WALL') AND cb NOT IN ('BOUNDARY', 'WALL') THEN 'CONNECTS' WHEN ca = 'WALL' AND cb = 'WALL' THEN 'ADJACENT_TO' ELSE 'TOUCHES' END AS relation FROM typed)"""


def _pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return view(spark, sf_dir, "f_objects"), view(spark, sf_dir, "f_rel")


@register(oracle(f"WITH {_TYPED} SELECT src, dst, relation FROM rel"))
def uso_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate relationships translated to typed ones."""
    return objects.resolve_relationships(*_pair(spark, sf_dir))


@register(
    oracle(
        """SELECT spatial_category, count(*) AS n, CASE WHEN spatial_category IN ('OPENING', 'PASSAGE', 'VERTICAL_CONNECTION') THEN count(*) ELSE 0 END AS n_traversable, CASE WHEN spatial_category IN ('OPENING', 'PASSAGE') THEN count(*) ELSE 0 END AS n_walkable,
  CASE WHEN spatial_category IN ('BOUNDARY', 'WALL') THEN count(*) ELSE 0 END AS n_obstacle, CASE WHEN spatial_category = 'VERTICAL_CONNECTION' THEN count(*) ELSE 0 END AS n_vertical_connector FROM f_objects GROUP BY spatial_category"""
    )
)
def accessibility_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accessibility flags counted by category."""
    return objects.accessibility_counts(view(spark, sf_dir, "f_objects"))


@register(
    oracle(
        """SELECT 'self_relation' AS check_name, ord AS key FROM f_rel WHERE src = dst
UNION ALL SELECT 'orphan_src', ord FROM f_rel WHERE src NOT IN (SELECT uso_id FROM f_objects) UNION ALL SELECT 'orphan_dst', ord FROM f_rel WHERE dst NOT IN (SELECT uso_id FROM f_objects)"""
    )
)
def uso_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity of objects and relationships."""
    return objects.object_audit(*_pair(spark, sf_dir))


@register(oracle("WITH bad AS (SELECT count(*) AS n FROM f_rel WHERE src = dst OR dst NOT IN (SELECT uso_id FROM f_objects)) SELECT uso_id, CASE WHEN n = 0 THEN 'VALIDATED' ELSE 'GENERATED' END AS status, CASE WHEN n = 0 THEN 2 ELSE 1 END AS revision FROM f_objects CROSS JOIN bad"))
def uso_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status of all objects after the integrity check."""
    o, r = _pair(spark, sf_dir)
    return objects.promote(o, objects.object_audit(o, r)).select("uso_id", "status", "revision")


@register(oracle("SELECT uso_id, rule_id, semantic_category FROM f_objects o JOIN f_rules r ON r.spatial_category = o.spatial_category"))
def semantic_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that fire on objects."""
    return objects.match_rules(view(spark, sf_dir, "f_objects"), view(spark, sf_dir, "f_rules")).select("uso_id", "rule_id", "semantic_category")


@register(
    oracle(
        """SELECT uso_id, rule_id, n - 1 AS n_discarded, n > 1 AS conflict FROM (SELECT uso_id, rule_id, count(*) OVER (PARTITION BY uso_id) AS n, row_number() OVER (PARTITION BY uso_id ORDER BY priority DESC, rule_ord) AS rn
FROM f_objects o JOIN f_more_rules r ON r.spatial_category = o.spatial_category) t WHERE rn = 1"""
    )
)
def conflict_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winning rule of every object and how many it beat."""
    return objects.resolve_conflicts(objects.match_rules(view(spark, sf_dir, "f_objects"), view(spark, sf_dir, "f_more_rules"))).select("uso_id", "rule_id", "n_discarded", "conflict")


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = view(spark, sf_dir, "f_objects")
    return objects.semantic_models(o, objects.resolve_conflicts(objects.match_rules(o, view(spark, sf_dir, "f_rules"))))


@register(oracle("SELECT uso_id, semantic_category, rule_id, CASE WHEN rule_id IS NULL THEN cast(0 AS double) ELSE cast(1 AS double) END AS confidence, CASE WHEN rule_id IS NULL THEN 'UNCLASSIFIED' ELSE 'DETERMINISTIC_RULE' END AS confidence_source FROM f_objects o LEFT JOIN f_rules r ON r.spatial_category = o.spatial_category"))
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic model of every object with its confidence."""
    return _models(spark, sf_dir)


@register(oracle("SELECT rule_id, count(*) AS n FROM f_objects o JOIN f_rules r ON r.spatial_category = o.spatial_category GROUP BY rule_id"))
def winning_rule_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects won by each rule."""
    return _models(spark, sf_dir).where("rule_id IS NOT NULL").groupBy("rule_id").agg(F.count(F.lit(1)).alias("n"))


@register(oracle("SELECT cast(NULL AS varchar) AS check_name, uso_id FROM f_objects WHERE false"))
def semantic_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity of the semantic models; no row is expected."""
    return objects.semantic_audit(view(spark, sf_dir, "f_objects"), _models(spark, sf_dir))


_AROUND = """around AS (SELECT src AS uso_id, dst AS other, relation, 'out' AS way FROM rel UNION ALL SELECT dst, src, relation, 'in' FROM rel)"""


def _agg(condition: str, name: str) -> str:
    return f"coalesce(string_agg(cast(other AS varchar), ',' ORDER BY other) FILTER (WHERE {condition}), '') AS {name}"


@register(
    oracle(
        f"""WITH {_TYPED}, {_AROUND} SELECT uso_id, {_agg("(relation = 'CONTAINS' AND way = 'in') OR (relation = 'BOUNDED_BY' AND way = 'out')", 'parents')}, {_agg("(relation = 'CONTAINS' AND way = 'out') OR (relation = 'BOUNDED_BY' AND way = 'in')", 'children')},
  {_agg("relation = 'ADJACENT_TO'", 'adjacent')}, {_agg("relation = 'CONNECTS'", 'connected')} FROM around GROUP BY uso_id"""
    )
)
def evidence_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents, children, adjacent and connected objects of each object."""
    found = objects.evidence(objects.resolve_relationships(*_pair(spark, sf_dir)))
    return found.select("uso_id", *(F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("parents", "children", "adjacent", "connected")))


@register(
    oracle(
        f"""WITH {_TYPED}, sem AS (SELECT o.uso_id, r.semantic_category AS c FROM f_objects o LEFT JOIN f_rules r ON r.spatial_category = o.spatial_category),
con AS (SELECT src AS u, dst AS v FROM rel WHERE relation = 'CONNECTS' UNION ALL SELECT dst, src FROM rel WHERE relation = 'CONNECTS'),
nb AS (SELECT u, count(*) AS n, count_if(s.c = 'ROOM') AS rooms FROM con JOIN sem s ON s.uso_id = con.v GROUP BY u),
d AS (SELECT s.uso_id AS object_id, CASE WHEN c = 'DOORWAY' AND rooms > 0 THEN 'ROOM_ENTRY' WHEN c = 'CORRIDOR' AND n >= 3 THEN 'CORRIDOR_INTERSECTION' WHEN c = 'CORRIDOR' AND n = 1 THEN 'DEAD_END'
  WHEN c = 'VERTICAL_CONNECTOR' THEN 'VERTICAL_CONNECTOR' WHEN c = 'DOORWAY' AND n = 1 AND rooms = 0 THEN 'BUILDING_ENTRY' END AS candidate_type, coalesce(n, 0) AS n_neighbours FROM sem s LEFT JOIN nb ON nb.u = s.uso_id)
SELECT * FROM d WHERE candidate_type IS NOT NULL"""
    )
)
def nav_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that become navigation candidates, by rule."""
    links = objects.resolve_relationships(*_pair(spark, sf_dir)).where("relation = 'CONNECTS'")
    return graphs.detect_candidates(_models(spark, sf_dir).select(F.col("uso_id").alias("object_id"), F.col("semantic_category").alias("category")), links)


@register(oracle("SELECT lang AS floor_id, doc_id, sha256(text) AS checksum, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS version FROM documents"))
def import_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versioned imports of each floor with their checksums."""
    docs = view(spark, sf_dir, "documents").select(F.col("lang").alias("floor_id"), "doc_id", F.col("text").alias("content"))
    return tables.import_versions(docs, "floor_id", "doc_id", "content").select("floor_id", "doc_id", "checksum", F.col("version").cast("long").alias("version"))


@register(oracle("SELECT lang AS floor_id, count(*) AS latest FROM documents GROUP BY lang"))
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version of each floor's imports."""
    docs = view(spark, sf_dir, "documents").select(F.col("lang").alias("floor_id"), "doc_id", F.lit("").alias("content"))
    return tables.import_versions(docs, "floor_id", "doc_id", "content").groupBy("floor_id").agg(F.max("version").cast("long").alias("latest"))


@register(oracle("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"))
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stay when all orders of one status go."""
    gone = view(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey")
    return tables.cascade(view(spark, sf_dir, "lineitem"), gone, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber", "l_partkey")


@register(oracle("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1"))
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that should be unique and are not."""
    return tables.unique_violations(view(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


@register(oracle("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'ARCHIVED' ELSE o_orderstatus END AS status, CASE WHEN o_orderstatus = 'O' THEN 2 ELSE 1 END AS revision FROM orders"))
def bulk_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders with those of one status updated and their revision raised."""
    rows = view(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.lit(1).alias("revision"))
    return tables.update(rows, F.col("status") == "O", {"status": F.lit("ARCHIVED")}, revision="revision")


@register(oracle("SELECT c_custkey, concat(substr(c_mktsegment, 1, 1), lower(substr(c_mktsegment, 2))) AS segment FROM customer"))
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segment names in title case."""
    return view(spark, sf_dir, "customer").select("c_custkey", g.title_case(F.col("c_mktsegment")).alias("segment"))


@register(oracle("SELECT l_orderkey, string_agg(concat(rn, ':', l_partkey), ',' ORDER BY rn) AS segments FROM f_lines GROUP BY l_orderkey"))
def nested_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes read with their ordered segments nested."""
    nested = tables.nest(view(spark, sf_dir, "f_lines"), "l_orderkey", "rn", "l_partkey")
    return nested.select("l_orderkey", F.array_join(F.transform("items", lambda s: F.concat_ws(":", s["rn"].cast("string"), s["l_partkey"].cast("string"))), ",").alias("segments"))


_VERSIONS = """m AS (SELECT o.uso_id, r.rule_id, version, semantic_category, priority, rule_ord FROM f_made_objects o JOIN f_rule_versions r ON r.spatial_category = o.spatial_category
  AND enabled AND (valid_from IS NULL OR valid_from <= made_at) AND (valid_to IS NULL OR made_at < valid_to)),
w AS (SELECT *, count(*) OVER (PARTITION BY uso_id) AS n, row_number() OVER (PARTITION BY uso_id ORDER BY priority DESC, rule_ord, version DESC) AS rn FROM m)"""


@register(oracle(f"WITH {_VERSIONS} SELECT uso_id, rule_id, cast(version AS integer) AS version, semantic_category FROM m"))
def rule_version_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions of rules that were enabled and valid when each object was made."""
    found = objects.match_versions(view(spark, sf_dir, "f_made_objects"), view(spark, sf_dir, "f_rule_versions"))
    return found.select("uso_id", "rule_id", "version", "semantic_category")


@register(
    oracle(
        f"""WITH {_VERSIONS} SELECT o.uso_id, w.semantic_category, w.rule_id, cast(w.version AS integer) AS version, CASE WHEN w.rule_id IS NULL THEN 'no enabled rule was valid' WHEN n > 1 THEN 'highest priority' ELSE 'only match' END AS reason,
CASE WHEN w.rule_id IS NULL THEN 'UNCLASSIFIED' ELSE 'CLASSIFIED' END AS status FROM f_made_objects o LEFT JOIN w ON w.uso_id = o.uso_id AND rn = 1"""
    )
)
def versioned_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every object with the rule and version that won, and why; of equal rules the newest version."""
    made = view(spark, sf_dir, "f_made_objects")
    found = objects.match_versions(made, view(spark, sf_dir, "f_rule_versions")).withColumn("rule_ord", F.struct("rule_ord", -F.col("version")))
    return objects.versioned_models(made, objects.resolve_conflicts(found))


def _inserted(name: str, key: str, columns: str, rows: str, held: str) -> str:
    return f"""SELECT '{name}' AS table_name, {columns}, NOT (EXISTS (SELECT 1 FROM ({held}) h WHERE h.k = t.k) OR rn > 1) AS accepted FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY ord) AS rn FROM ({rows}) r) t"""


_NEW_CANDIDATES = "SELECT concat(graph_id, '|', cast(object_id AS {s})) AS k, candidate_id AS ord FROM f_graph_candidates"
_NEW_EDGES = "SELECT concat(graph_id, '|', src, '|', dst) AS k, edge_ord AS ord FROM f_dirty_edges"
_NEW_SEGMENTS = "SELECT concat(cast(l_orderkey AS {s}), '|', cast(l_linenumber AS {s})) AS k, l_orderkey * 100000 + l_partkey AS ord FROM lineitem UNION ALL SELECT concat(cast(o_orderkey AS {s}), '|1') AS k, o_orderkey AS ord FROM orders"
_INSERTS = {"candidates": (_NEW_CANDIDATES, "ord % 4 = 0"), "edges": (_NEW_EDGES, "ord % 3 = 0"), "segments": (_NEW_SEGMENTS, "ord % 50 = 0")}


@register(oracle(" UNION ALL ".join(_inserted(n, "k", "k, ord", rows.format(s="varchar"), f"SELECT k FROM ({rows.format(s='varchar')}) x WHERE {held}") for n, (rows, held) in _INSERTS.items())))
def unique_inserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates, edges and segments offered to tables that hold some of them already: which are taken, and which repeat a key."""
    out = None
    for name, (sql, held) in _INSERTS.items():
        for other in ("f_graph_candidates", "f_dirty_edges", "lineitem", "orders"):
            view(spark, sf_dir, other).createOrReplaceTempView(other)
        rows = spark.sql(sql.format(s="string"))
        taken, left = tables.insert_unique(rows.where(held), rows.select("ord", "k"), "k")
        both = taken.withColumn("accepted", F.lit(True)).unionByName(left.withColumn("accepted", F.lit(False))).select(F.lit(name).alias("table_name"), "k", "ord", "accepted")
        out = both if out is None else out.unionByName(both)
    return out
