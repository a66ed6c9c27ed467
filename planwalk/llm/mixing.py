"""Mixing sources to target weights by fitting budgets with subset sums.

1. Sizes of whole texts are counted; documents become a histogram (source, size, count), which
   is aggregated before anything is shuffled, so a hot source is some thousand rows.
2. Targets: sources share a budget by weight, a source stops at its cap, and what it leaves is
   shared out again by weight until no source is above its cap.
3. A source takes all its documents as often as they fit whole into its target.  The rest of
   the target is a bounded knapsack over the histogram: the same share of every size first,
   then the longest sizes that still fit, and what is left of the budget, a window of bounded
   width, is filled by dynamic programming over sums with the counts that remain.
4. Documents are selected by count of each size, in the order of a seeded hash.  The rank of a
   document within its size is counted in hash buckets whose counts are summed up, so that a
   size which most documents share is never in one task.

Rows that repeat id, text and source are one entry with a number of copies until the end; the
knapsack counts every copy.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwalk.llm.store import fresh, row_key, written

#: Space and the ASCII characters from tab to carriage return.
SPACES = " \t\n\x0b\f\r"
#: Sums that the dynamic programming looks at, beyond the shortest document's size.
SUMS = 1 << 20
#: Entries of a source and size that are ranked in one bucket.
BUCKET = 512
#: Copies of one row that one task writes.
COPIES = 16_384


def n_words(text: Column) -> Column:
    """Number of runs of characters that are no white space; null has none.  No list of words is made."""
    marks = F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "x")
    return F.coalesce(F.length(F.translate(marks, SPACES, "")), F.lit(0)).cast("long")


def entries(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(id, source, dk, dk2, size, copies): the documents; rows that repeat id, text and source are one."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), *row_key(id_col, text_col), n_words(F.col(text_col)).alias("size"))
    return rows.groupBy("id", "source", "dk", "dk2", "size").agg(F.count(F.lit(1)).alias("copies"))


def numbered(sources: DataFrame) -> DataFrame:
    """sources (one row each) with `at`, the place of the source by code point from 0, null last, counted without one task for all."""
    n = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("source").isNull(), F.col("source")]
    ranged = sources.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the number of a partition in the upper bits, of a row within it in the lower ones; written, so that both stay
    rows = written(ranged.withColumn("row", F.monotonically_increasing_id()), "sources").withColumn("part", F.shiftright("row", 33))
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    firsts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    return rows.join(F.broadcast(firsts), "part").withColumn("at", F.col("first") + F.col("row").bitwiseAND((1 << 33) - 1)).drop("part", "row", "first")


def targets(sizes: DataFrame, weights: Sequence[int], percent: int, most: int) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in the order of numbered() weigh `weights`, repeating, and share `percent` % of all
    sizes; no target is above `most` times its source's size, and what that leaves is shared
    out by weight among the others, again and again until none is above.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("at") % len(weights) + 1).cast("int"))
    exact = "decimal(38,0)"
    rows = numbered(sizes).withColumn("weight", weight.cast(exact)).withColumn("cap", (F.col("source_size") * most).cast(exact))
    rows = written(rows, "weighed-sources")
    first = rows.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    # in hundredths of words, so that all is exact up to the last division
    budget = percent * int(first["size"] or 0)
    left, weighed, stopped = budget, int(first["weight"] or 0), 0
    while True:
        stops = F.col("weight") * F.lit(left).cast(exact) > F.col("cap") * F.lit(100 * weighed).cast(exact)
        found = rows.agg(F.sum(F.when(~stops, F.col("weight"))).alias("weight"), F.sum(F.when(stops, F.col("cap"))).alias("cap"), F.count_if(stops).alias("n")).first()
        if found["n"] == stopped:
            break
        left, weighed, stopped = budget - 100 * int(found["cap"] or 0), int(found["weight"] or 0), found["n"]
        if not weighed:
            stops = F.lit(True)
            break
    share = (F.col("weight") * F.lit(left).cast(exact)).cast("double") / F.lit(float(max(100 * weighed, 1)))
    return rows.select("source", "source_size", F.when(stops, F.col("cap").cast("double")).otherwise(share).alias("target"))


def nearest_sum(sizes: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many of each size to take, at most `counts`, for the sum next to the budget, the lower of two.

    `first` remembers for every sum the size by which it was first reached.  Sizes are gone
    through one after the other, so along the way back from a sum each size occurs at most
    as often as it may.
    """
    fit = np.zeros(len(sizes), np.int64)
    usable = np.flatnonzero((sizes > 0) & (counts > 0))
    if not len(usable) or 2 * budget < sizes[usable].min():
        return fit
    if budget > 8 * SUMS:
        # every document left is about as long as the budget or longer: one of them or none
        gaps = np.abs(sizes[usable] - budget)
        if gaps.min() < budget:
            fit[usable[gaps.argmin()]] = 1
        return fit
    last = int(min(2 * budget, budget + SUMS))
    goal = max(0, int(np.ceil(budget - 0.5)))
    first = np.full(last + 1, -1, np.int32)
    first[0] = len(sizes)
    for i in usable[np.argsort(-sizes[usable], kind="stable")].tolist():
        size = int(sizes[i])
        sums = np.flatnonzero(first[: max(last + 1 - size, 0)] >= 0)
        for _ in range(int(counts[i])):
            sums = sums[sums <= last - size] + size
            sums = sums[first[sums] < 0]
            if not len(sums):
                break
            first[sums] = i
        if goal <= last and first[goal] >= 0:
            break
    reached = np.flatnonzero(first >= 0)
    total = int(reached[np.abs(reached - budget).argmin()])
    while total > 0:
        fit[first[total]] += 1
        total -= int(sizes[first[total]])
    return fit


def plan(sizes: np.ndarray, counts: np.ndarray, target: float, most: int) -> tuple[int, np.ndarray]:
    """(times, take): all documents are taken `times` times, and of each size `take` documents once more."""
    total = sum(s * c for s, c in zip(sizes.tolist(), counts.tolist(), strict=True))
    take = np.zeros(len(sizes), np.int64)
    if not total:
        return 0, take
    times = min(int(target // total), most)
    budget = target - times * total
    if times == most or budget <= 0:
        return times, take
    # a hair less than the share, so that rounding cannot take too many
    take = np.minimum(np.floor(counts * (budget / total * (1 - 1e-12))).astype(np.int64), counts)
    budget -= sum(s * c for s, c in zip(sizes.tolist(), take.tolist(), strict=True))
    for i in np.argsort(-sizes, kind="stable").tolist():
        over = budget - SUMS // 2
        if over <= 0 or not sizes[i]:
            break
        more = min(int(counts[i] - take[i]), int(over // int(sizes[i])))
        take[i] += more
        budget -= more * int(sizes[i])
    return times, take + nearest_sum(sizes, counts - take, budget)


_PLAN = "source string, size long, n long, copies long, source_size long, target double, times long, need long"


def planned(rows: DataFrame, weights: Sequence[int], percent: int, most: int) -> DataFrame:
    """(source, size, n, copies, source_size, target, times, need): for each size of a source its entries and documents, and how many of the latter are taken once more."""
    cells = written(rows.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies")), "sizes")
    goals = targets(cells.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, percent, most)

    def task(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("size")
        times, take = plan(cells["size"].to_numpy(), cells["copies"].to_numpy(), float(cells["target"].iloc[0]), most)
        return cells.assign(times=times, need=take)

    # a group is the histogram of a source: as many rows as it has different sizes, whatever its documents
    goals = goals.withColumnRenamed("source", "_of")
    joined = cells.join(goals, F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    return written(joined.groupBy("source").applyInPandas(task, _PLAN), "plan")


def chosen(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """rows with source_size, target, times and `more`, the number of a row's copies that are taken once more."""
    p = plan.select(F.col("source").alias("_s"), F.col("size").alias("_z"), *(F.col(c) for c in ("source_size", "target", "times", "need")), F.col("copies").alias("_all"), F.col("n").alias("_n"))
    same = F.col("source").eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z"))
    bucket = F.pmod("_h", F.ceil(F.col("_n") / BUCKET)).alias("_b")
    # ranked in an order of the seed's own
    dealt = rows.withColumn("_h", F.xxhash64(F.lit(seed), "dk", "dk2")).join(p, same).drop("_s", "_z").select("*", bucket)
    open_ = (F.col("need") > 0) & (F.col("need") < F.col("_all"))
    settled = dealt.where(~open_).withColumn("more", F.when(F.col("need") > 0, F.col("copies")).otherwise(0))
    cells = dealt.where(open_).groupBy("source", "size", "_b").agg(F.sum("copies").alias("held"), F.first("need").alias("wanted"))
    before = Window.partitionBy("source", "size").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cells = written(cells.withColumn("left", F.col("wanted") - F.coalesce(F.sum("held").over(before), F.lit(0))), "buckets")
    cells = cells.select(F.col("source").alias("_s"), F.col("size").alias("_z"), F.col("_b").alias("_c"), "held", "left")
    inside = dealt.where(open_).join(cells, same & (F.col("_b") == F.col("_c"))).drop("_s", "_z", "_c")
    full = inside.where((F.col("left") <= 0) | (F.col("left") >= F.col("held")))
    full = full.withColumn("more", F.when(F.col("left") > 0, F.col("copies")).otherwise(0)).drop("held", "left")
    # one bucket of a size at most is cut in two
    order = Window.partitionBy("source", "size", "_b").orderBy("_h", "dk", "dk2", "id").rowsBetween(Window.unboundedPreceding, -1)
    cut = inside.where((F.col("left") > 0) & (F.col("left") < F.col("held"))).withColumn("_r", F.coalesce(F.sum("copies").over(order), F.lit(0)))
    cut = cut.withColumn("more", F.greatest(F.least(F.col("left") - F.col("_r"), F.col("copies")), F.lit(0))).drop("held", "left", "_r")
    return settled.unionByName(full).unionByName(cut).drop("_h", "_b", "_n", "_all", "need")


def selection(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), percent: int = 150, most: int = 2, seed: int = 13, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, dk, dk2, size, copies, source_size, target, times, more): one row for the rows that repeat id, text and source.

    Each of the copies is taken `times` times, `more` of them once more.
    """
    rows = written(entries(docs, id_col, text_col, source_col), "mix-entries")
    return chosen(rows, planned(rows, weights, percent, most), seed)


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), percent: int = 150, most: int = 2, seed: int = 13, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id_col, source, size, source_size, target, taken) of every document.

    Sources by code point, null last, weigh `weights`, repeating, and share `percent` % of all
    words; a source takes at most `most` times its own, and so does a document.  Null and empty
    texts have no words and none are taken.  Repeated rows are documents of their own; which of
    them is taken once more makes no difference.  The seeded choice depends on ids and texts
    alone, so reruns agree whatever the partitions.  Empty tables give no rows; other columns,
    whatever their names, are not looked at.
    """
    found = written(selection(docs, weights, percent, most, seed, id_col, text_col, source_col), "mix")
    kinds = F.array(F.struct(F.col("more").alias("n"), (F.col("times") + 1).alias("t")), F.struct((F.col("copies") - F.col("more")).alias("n"), F.col("times").alias("t")))
    rows = found.select("id", "source", "size", "source_size", "target", F.explode(F.filter(kinds, lambda k: k["n"] > 0)).alias("k"))
    few = rows.where(F.col("k.n") <= COPIES)
    # many copies of a row are written by many tasks
    many = rows.where(F.col("k.n") > COPIES).withColumn("_at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k.n") - 1, F.lit(COPIES).cast("long"))))
    many = many.withColumn("k", F.struct(F.least(F.col("k.n") - F.col("_at"), F.lit(COPIES)).alias("n"), F.col("k.t").alias("t"))).repartition("id", "_at").drop("_at")
    each = few.unionByName(many).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k.n"))))
    return each.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", (F.col("size") * F.col("k.t")).alias("taken"))


def mixed(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), percent: int = 150, most: int = 2, seed: int = 13, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of docs with all their columns, each as often as it is taken."""
    s, d, e, n, t, m, r = fresh(docs, "s", "d", "e", "n", "t", "m", "r")
    found = selection(docs, weights, percent, most, seed, id_col, text_col, source_col)
    found = found.where("times + more > 0").select(*(F.col(a).alias(b) for a, b in (("source", s), ("dk", d), ("dk2", e), ("copies", n), ("times", t), ("more", m))))
    dk, dk2 = row_key(id_col, text_col)
    rows = docs.join(found, (dk == F.col(d)) & (dk2 == F.col(e)) & F.col(source_col).cast("string").eqNullSafe(F.col(s)))
    split = (F.col(m) > 0) & (F.col(m) < F.col(n))
    whole = rows.where(~split).withColumn(r, F.when(F.col(m) > 0, F.col(t) + 1).otherwise(F.col(t)))
    # of rows that repeat id, text and source some are taken once more and others are not: at most one such group of a source and size
    order = Window.partitionBy(d, e, s).orderBy(d)
    parted = rows.where(split).withColumn(r, F.col(t) + F.when(F.row_number().over(order) <= F.col(m), 1).otherwise(0))
    out = whole.unionByName(parted).where(F.col(r) > 0)
    return out.withColumn(r, F.explode(F.sequence(F.lit(1).cast("long"), F.col(r)))).select(*docs.columns)
