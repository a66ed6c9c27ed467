"""Spatial objects, their typed relationships, and rule-based semantics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwalk.operators.routing import violation

#: Category, then traversable, walkable, obstacle, vertical connector.
ACCESSIBILITY = (
    ("BOUNDARY", False, False, True, False),
    ("WALL", False, False, True, False),
    ("ENCLOSURE", False, False, False, False),
    ("OPENING", True, True, False, False),
    ("PASSAGE", True, True, False, False),
    ("VERTICAL_CONNECTION", True, False, False, True),
)
CONNECTABLE = ("OPENING", "PASSAGE", "ENCLOSURE", "VERTICAL_CONNECTION")
FLAGS = ("traversable", "walkable", "obstacle", "vertical_connector")
RELATION_TYPES = ("CONTAINS", "WITHIN", "ADJACENT_TO", "CONNECTS", "BOUNDED_BY", "TOUCHES", "INTERSECTS")
#: Status to the statuses that may follow it.
STATUS_HOPS = (("GENERATED", "VALIDATED"), ("VALIDATED", "PUBLISHED"), ("PUBLISHED", "DEPRECATED"))


def accessibility(objects: DataFrame) -> DataFrame:
    """Adds the four flags of an object's category."""
    table = objects.sparkSession.createDataFrame(list(ACCESSIBILITY), "spatial_category string, " + ", ".join(f"{f} boolean" for f in FLAGS))
    return objects.join(F.broadcast(table), "spatial_category", "left")


def accessibility_counts(objects: DataFrame) -> DataFrame:
    return accessibility(objects).groupBy("spatial_category").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(f)).alias(f"n_{f}") for f in FLAGS))


def relation_type(candidate: Column, a: Column, b: Column) -> tuple[Column, Column]:
    """(type, swapped) of a candidate relationship between two categories; type is null for a candidate that is not known."""
    forth = (a == "BOUNDARY") & (b == "WALL")
    back = (a == "WALL") & (b == "BOUNDARY")
    touch = F.when(a.isin(*CONNECTABLE) & b.isin(*CONNECTABLE), "CONNECTS").when((a == "WALL") & (b == "WALL"), "ADJACENT_TO").when(forth | back, "BOUNDED_BY").otherwise("TOUCHES")
    kind = (
        F.when(candidate == "CONTAINS", F.when(forth | back, "BOUNDED_BY").otherwise("CONTAINS"))
        .when(candidate == "ADJACENT", "ADJACENT_TO")
        .when(candidate == "TOUCHES", touch)
        .when(candidate == "INTERSECTS", "INTERSECTS")
    )
    return kind, candidate.isin("CONTAINS", "TOUCHES") & back


def resolve_relationships(objects: DataFrame, candidates: DataFrame) -> DataFrame:
    """(src, dst, relation): candidates with both ends translated, once per direction and type; dangling and unknown ones are dropped."""
    rows = candidates
    for end in ("src", "dst"):
        rows = rows.join(objects.select(F.col("uso_id").alias(end), F.col("spatial_category").alias(f"{end}_category")), end)
    kind, swapped = relation_type(F.col("candidate_type"), F.col("src_category"), F.col("dst_category"))
    rows = rows.withColumn("relation", kind).where("relation IS NOT NULL")
    return rows.select(F.when(swapped, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(swapped, F.col("src")).otherwise(F.col("dst")).alias("dst"), "relation").distinct()


def object_audit(objects: DataFrame, relationships: DataFrame) -> DataFrame:
    """(check_name, key): repeated objects, relationships from an object to itself, with an unknown end or an unknown type."""
    out = objects.groupBy("uso_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*violation("duplicate_object", F.col("uso_id").alias("key")))
    out = out.unionByName(relationships.where("src = dst").select(*violation("self_relation", F.col("ord").alias("key"))))
    for end in ("src", "dst"):
        out = out.unionByName(relationships.join(objects.select(F.col("uso_id").alias(end)), end, "left_anti").select(*violation(f"orphan_{end}", F.col("ord").alias("key"))))
    return out.unionByName(relationships.where(~F.col("candidate_type").isin("CONTAINS", "ADJACENT", "TOUCHES", "INTERSECTS")).select(*violation("unknown_type", F.col("ord").alias("key"))))


def may_follow(before: Column, after: Column) -> Column:
    out = F.lit(False)
    for a, b in STATUS_HOPS:
        out = out | ((before == a) & (after == b))
    return out


def promote(objects: DataFrame, violations: DataFrame) -> DataFrame:
    """Objects as VALIDATED with the next revision, unless anything at all is in violation."""
    clean = violations.limit(1).agg((F.count(F.lit(1)) == 0).alias("clean"))
    return objects.crossJoin(F.broadcast(clean)).withColumn("status", F.when(F.col("clean"), "VALIDATED").otherwise("GENERATED")).withColumn("revision", F.when(F.col("clean"), 2).otherwise(1)).drop("clean")


def match_rules(objects: DataFrame, rules: DataFrame) -> DataFrame:
    """Every rule that fires on every object."""
    return objects.join(rules, "spatial_category")


def match_versions(objects: DataFrame, rules: DataFrame) -> DataFrame:
    """Every enabled version of a rule that was valid when an object was made, and fires on it.

    objects: uso_id, spatial_category, made_at; rules: rule_id, version, enabled, valid_from and
    valid_to (exclusive, null for open ends) beside what match_rules takes.  The category is an
    equi-join; the interval is tested within it, over the few versions of a category's rules.
    """
    at = F.col("made_at")
    valid = (F.col("valid_from").isNull() | (F.col("valid_from") <= at)) & (F.col("valid_to").isNull() | (at < F.col("valid_to")))
    return objects.join(rules.where("enabled"), "spatial_category").where(valid)


def versioned_models(objects: DataFrame, winners: DataFrame) -> DataFrame:
    """Every object with the category, rule and version of its winning match, and the reason; without one it is UNCLASSIFIED."""
    won = winners.select("uso_id", "semantic_category", "rule_id", "version", "n_discarded")
    has = F.col("rule_id").isNotNull()
    reason = F.when(~has, "no enabled rule was valid").when(F.col("n_discarded") > 0, "highest priority").otherwise("only match")
    return objects.select("uso_id").join(won, "uso_id", "left").select("uso_id", "semantic_category", "rule_id", "version", reason.alias("reason"), F.when(has, "CLASSIFIED").otherwise("UNCLASSIFIED").alias("status"))


def resolve_conflicts(matches: DataFrame) -> DataFrame:
    """The match of highest priority of each object, then the earliest rule, with the number of matches it beat."""
    order = Window.partitionBy("uso_id").orderBy(F.desc("priority"), "rule_ord")
    n = F.count(F.lit(1)).over(Window.partitionBy("uso_id"))
    return matches.withColumn("rn", F.row_number().over(order)).withColumn("n_discarded", n - 1).where("rn = 1").drop("rn").withColumn("conflict", F.col("n_discarded") > 0)


def semantic_models(objects: DataFrame, winners: DataFrame) -> DataFrame:
    """Every object with its category, rule and confidence: 1 by a rule, 0 and UNCLASSIFIED without."""
    won = winners.select("uso_id", "semantic_category", "rule_id")
    has = F.col("rule_id").isNotNull()
    return objects.join(won, "uso_id", "left").select(
        "uso_id", "semantic_category", "rule_id", F.when(has, 1.0).otherwise(0.0).alias("confidence"), F.when(has, "DETERMINISTIC_RULE").otherwise("UNCLASSIFIED").alias("confidence_source")
    )


def semantic_audit(objects: DataFrame, models: DataFrame) -> DataFrame:
    """(check_name, uso_id): models without an object, repeats, confidence outside 0..1, a category without confidence."""
    out = models.join(objects.select("uso_id"), "uso_id", "left_anti").select(*violation("orphan", "uso_id"))
    out = out.unionByName(models.groupBy("uso_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*violation("duplicate", "uso_id")))
    out = out.unionByName(models.where("confidence < 0 OR confidence > 1").select(*violation("confidence_range", "uso_id")))
    return out.unionByName(models.where("semantic_category IS NOT NULL AND confidence = 0").select(*violation("no_confidence", "uso_id")))


def evidence(relationships: DataFrame) -> DataFrame:
    """(uso_id, parents, children, adjacent, connected): sorted ids around each object that has relationships."""
    there = relationships.select(F.col("src").alias("uso_id"), F.col("dst").alias("other"), "relation", F.lit("out").alias("way"))
    both = there.unionByName(relationships.select(F.col("dst").alias("uso_id"), F.col("src").alias("other"), "relation", F.lit("in").alias("way")))

    def ids(condition: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.expr(condition), F.col("other"))))

    return both.groupBy("uso_id").agg(
        ids("(relation = 'CONTAINS' AND way = 'in') OR (relation = 'BOUNDED_BY' AND way = 'out')").alias("parents"),
        ids("(relation = 'CONTAINS' AND way = 'out') OR (relation = 'BOUNDED_BY' AND way = 'in')").alias("children"),
        ids("relation = 'ADJACENT_TO'").alias("adjacent"),
        ids("relation = 'CONNECTS'").alias("connected"),
    )
