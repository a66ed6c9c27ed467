"""Uploads, keyed reads, identifiers, pairs, sizes and whole geometry models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwalk.functions import geometry as g
from planwalk.operators import shapes, tables
from planwalk.plans.object_queries import _models
from planwalk.plans.shape_queries import _BOX, _CANDIDATES, _GAPS
from planwalk.plans.views import oracle, view
from planwalk.registry import register

#: What may be uploaded as a plan.
PLAN_KINDS = ("image/svg+xml",)


@register(
    """SELECT page_id, CASE WHEN html IS NULL OR page_id % 11 = 0 THEN 'no_file' WHEN page_id % 5 > 1 THEN 'unsupported_type' WHEN strlen(html) * 1000 > 20971520 THEN 'too_large' END AS reason FROM pages"""
)
def upload_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why pages, taken as uploads of several kinds and a thousand times their length, are refused; null for those that are taken."""
    k = F.col("page_id")
    kind = F.when(k % 5 < 2, "image/svg+xml").when(k % 5 == 2, "image/png").when(k % 5 == 3, "image/svg+xml; charset=utf-8")
    files = view(spark, sf_dir, "pages").select("page_id", kind.alias("mime"), F.when(k % 11 > 0, F.octet_length("html").cast("long") * 1000).alias("length"))
    return tables.upload_reasons(files, PLAN_KINDS).select("page_id", "reason")


@register(oracle("SELECT uso_id, semantic_category, rule_id FROM f_objects o LEFT JOIN f_rules r ON r.spatial_category = o.spatial_category WHERE uso_id IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')"))
def keyed_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic models of the objects that urgent orders name."""
    keys = view(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("uso_id"))
    return tables.by_keys(_models(spark, sf_dir), keys, "uso_id").select("uso_id", "semantic_category", "rule_id")


@register(
    r"""WITH t AS (SELECT c_custkey, md5(c_name) AS m FROM customer), u AS (SELECT c_custkey, concat(substr(m, 1, 8), '-', substr(m, 9, 4), '-', CASE WHEN c_custkey % 3 = 0 THEN '4' ELSE substr(m, 13, 1) END, substr(m, 14, 3), '-', substr(m, 17, 4), '-', substr(m, 21, 12)) AS s FROM t),
w AS (SELECT c_custkey, CASE c_custkey % 8 WHEN 1 THEN upper(s) WHEN 2 THEN concat('{', s, '}') WHEN 3 THEN concat(s, ' ') WHEN 4 THEN NULL ELSE s END AS s FROM u)
SELECT c_custkey, s AS text, coalesce(regexp_full_match(lower(s), '[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}'), false) AS valid FROM w"""
)
def uuid_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether texts made of the customers' names are UUIDs of versions 1 to 5."""
    k = F.col("c_custkey")
    m = F.md5("c_name")
    s = F.concat_ws("-", F.substring(m, 1, 8), F.substring(m, 9, 4), F.concat(F.when(k % 3 == 0, "4").otherwise(F.substring(m, 13, 1)), F.substring(m, 14, 3)), F.substring(m, 17, 4), F.substring(m, 21, 12))
    text = F.when(k % 8 == 1, F.upper(s)).when(k % 8 == 2, F.concat(F.lit("{"), s, F.lit("}"))).when(k % 8 == 3, F.concat(s, F.lit(" "))).when(k % 8 == 4, None).otherwise(s)
    return view(spark, sf_dir, "customer").select("c_custkey", text.alias("text")).select("c_custkey", "text", g.is_uuid(F.col("text")).alias("valid"))


@register(oracle("SELECT concat(cast(least(src, dst) AS varchar), '|', cast(greatest(src, dst) AS varchar)) AS pair, count(*) AS n, count(DISTINCT src) AS n_ways FROM f_rel GROUP BY 1"))
def relationship_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unordered pairs of objects between which there are relationships, with how many and in how many directions."""
    pair = g.pair_key(F.col("src"), F.col("dst"))
    # a pair has two sources at most, so the least and the greatest tell them
    return view(spark, sf_dir, "f_rel").groupBy(pair.alias("pair")).agg(F.count(F.lit(1)).alias("n"), (F.min("src") != F.max("src")).cast("long").alias("_two")).select("pair", "n", (F.col("_two") + 1).alias("n_ways"))


@register(oracle(f"WITH b AS (SELECT import_id, id, {_BOX} FROM f_prims) SELECT import_id, id, x1 - x0 AS width, y1 - y0 AS height FROM b"))
def box_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width and height of the box around every shape."""
    box = F.col("box")
    rows = view(spark, sf_dir, "f_prims").select("import_id", "id", shapes.box_column().alias("box"))
    return rows.select("import_id", "id", g.box_width(box).alias("width"), g.box_height(box).alias("height"))


_REMOVED = """judged AS (SELECT *, coalesce(CASE type WHEN 'circle' THEN r = 0 WHEN 'rect' THEN w = 0 OR h = 0 ELSE w = 0 AND h = 0 END, false) AS flat FROM f_prims),
gone AS (SELECT import_id, ord, flat, concat(type, ' ''', id, ''' removed: ', CASE WHEN flat THEN 'zero-length or degenerate' ELSE 'duplicate' END) AS warning FROM judged WHERE flat OR ord NOT IN (SELECT ord FROM f_clean))"""


@register(oracle(f"WITH {_REMOVED} SELECT import_id, ord, row_number() OVER (PARTITION BY import_id ORDER BY NOT flat, ord) - 1 AS place, warning FROM gone"))
def removal_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts about the shapes that cleaning removes."""
    return shapes.removal_warnings(view(spark, sf_dir, "f_prims"))


@register(
    oracle(
        f"""WITH {_CANDIDATES}, {_GAPS}, {_REMOVED},
every AS (SELECT import_id, place, cid FROM cand UNION ALL SELECT import_id, 3, concat('opening-', cast(component AS varchar)) FROM gaps),
l1 AS (SELECT import_id, string_agg(id, ',' ORDER BY ord) AS shapes, min(x0) AS min_x, max(y1) AS max_y FROM (SELECT import_id, ord, id, {_BOX} FROM f_clean) s GROUP BY import_id), l2 AS (SELECT import_id, string_agg(warning, ';' ORDER BY NOT flat, ord) AS warnings FROM gone GROUP BY import_id),
l3 AS (SELECT import_id, string_agg(concat(cast(node_no AS varchar), ':', cast(x AS varchar), ':', cast(y AS varchar), ':', cast(degree AS varchar)), ',' ORDER BY node_no) AS nodes FROM nodes GROUP BY import_id),
l4 AS (SELECT s.import_id, string_agg(concat(s.id, '/', cast(seg AS varchar), ':', cast(a.node_no AS varchar), '>', cast(b.node_no AS varchar)), ',' ORDER BY s.ord, seg) AS edges FROM segs s JOIN nodes a ON a.import_id = s.import_id AND a.x = s.ax AND a.y = s.ay JOIN nodes b ON b.import_id = s.import_id AND b.x = s.bx AND b.y = s.bz GROUP BY s.import_id),
l5 AS (SELECT import_id, string_agg(cid, ',' ORDER BY place, cid) AS candidates FROM every GROUP BY import_id)
SELECT i.import_id, coalesce(shapes, '') AS shapes, coalesce(warnings, '') AS warnings, coalesce(nodes, '') AS nodes, coalesce(edges, '') AS edges, coalesce(candidates, '') AS candidates, min_x, max_y FROM (SELECT DISTINCT import_id FROM f_prims) i
LEFT JOIN l1 ON l1.import_id = i.import_id LEFT JOIN l2 ON l2.import_id = i.import_id LEFT JOIN l3 ON l3.import_id = i.import_id LEFT JOIN l4 ON l4.import_id = i.import_id LEFT JOIN l5 ON l5.import_id = i.import_id"""
    )
)
def geometry_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole geometry model of every plan in one row: shapes, warnings, nodes, edges, candidates and box."""
    given = view(spark, sf_dir, "f_prims")
    topology = shapes.Topology(shapes.clean(given))
    found = shapes.geometry_models(given, topology, shapes.candidates(topology))
    joined = lambda c, *parts: F.array_join(F.transform(c, lambda v: F.concat(*(F.lit(p[1:]) if p[0] == "=" else v[p].cast("string") for p in parts))), ",").alias(c)
    return found.select(
        "import_id", joined("shapes", "id"), F.array_join("warnings", ";").alias("warnings"), joined("nodes", "node_no", "=:", "x", "=:", "y", "=:", "degree"),
        joined("edges", "id", "=/", "seg", "=:", "from_node", "=>", "to_node"), joined("candidates", "candidate_id"), F.col("box.min_x").alias("min_x"), F.col("box.max_y").alias("max_y"),
    )
