"""Near-duplicate documents by an inverted join over MinHash signature coordinates.

1. Every document becomes the set of its word shingles; documents with equal sets are one
   class from here on, so exact copies never meet each other again.
2. A class is posted under each (coordinate, value) of its signature.  Two classes are worth
   a look if at least `matches` of the `coordinates` collide, so it is enough that they meet
   in the rarest `coordinates - matches + 1` postings of each, in one order for all (prefix).
3. In each posting list every class is confirmed against the list's smallest class, which
   joins the bulk of a large group in one linear round; only classes of a list that are still
   in different components are compared with each other.  Lists over `BLOCK` classes are
   compared in blocks, the minority of a list against the whole list, and a pair is skipped
   unless the list at hand is the first that both share (skip merging).  A minority over
   `BLOCK` classes meets one block of its list before, which is linear and joins those that
   are near to many others, if not to the smallest class.
4. Each link is confirmed on the full sets.  Components of links are the groups, so a block
   returns which components its near pairs join, a row for each, and not the pairs.

With 48 coordinates and 26 matches, a pair at similarity 0.8 is missed with a probability of
1.3e-5 if coordinates are independent, and a closer one far more rarely.  Words and shingles
are told apart by 64-bit hashes without a structure that texts could share; two different
sets of n and m shingles have one in common by accident with a probability of n * m / 2^64.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwalk.llm import shingles, wordhash
from planwalk.llm.store import written
from planwalk.operators.components import connected_components

COORDINATES = 48
MATCHES = 26
#: Longest posting list whose pairs are listed, and the number of classes in a block of a longer one.
SHORT_LIST = 64
BLOCK = 512
#: Bits of the fixed-size bitmap that keeps other rows' texts out of the second scan.
BITMAP_BITS = 1 << 25
_BUCKET_BITS = 32768  # of Spark's bitmap functions


def _longs(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def _digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def signatures(docs: DataFrame, size: int, coordinates: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, digest, sig): set size, digest of the set (null for the empty set) and signature of every row."""
    multipliers, shifts = shingles.family(coordinates)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = wordhash.text_buffer(batch.column(1))
            for i, j, hashes, counts in shingles.sets(data, offsets, size):
                some = np.flatnonzero(counts)
                ends = np.cumsum(counts)
                digests: list[bytes | None] = [None] * (j - i)
                for r in some.tolist():
                    digests[r] = _digest(hashes[ends[r] - counts[r] : ends[r]])
                sig = shingles.signatures(hashes, counts, multipliers, shifts) if len(some) else np.zeros((0, coordinates), np.uint64)
                at = np.concatenate(([0], np.cumsum(np.where(counts > 0, coordinates, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(counts), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(at), _longs(sig.reshape(-1)))],
                    names=["id", "n", "digest", "sig"],
                )

    return _rows(docs, id_col, text_col).mapInArrow(task, "id long, n long, digest binary, sig array<long>")


def _bitmap(ids: DataFrame) -> dict[int, bytes]:
    """Bits of the hashes of ids: at most BITMAP_BITS of them whatever the number of rows."""
    # Spark's bitmap functions number the bits from 1
    bit = F.pmod(F.xxhash64("id"), F.lit(BITMAP_BITS)) + 1
    rows = ids.select(bit.alias("v")).groupBy(F.bitmap_bucket_number("v").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("v")).alias("m")).collect()
    return {r["k"]: bytes(r["m"]) for r in rows}


def _classes(rows: DataFrame) -> DataFrame:
    """(digest, id, node): one row per class of equal sets with its smallest id; node is a number of its own.

    Numbers are 64 bits of the digest; digests that share them are told apart by their order.
    """
    classes = rows.where("n > 0").groupBy("digest").agg(F.min("id").alias("id"))
    short = F.xxhash64("digest")
    nth = F.row_number().over(Window.partitionBy(short).orderBy("digest")) - 1
    return classes.select("digest", "id", (short.bitwiseXOR(nth.cast("long"))).alias("node"))


def _sets(docs: DataFrame, nodes: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(node, set): the full shingle sets of `nodes` (node, id, digest), from one more scan that takes only their documents; a node may come twice."""
    bits = np.zeros(BITMAP_BITS // 8, np.uint8)
    for k, m in _bitmap(nodes.select("id")).items():
        at = (k - 1) * (_BUCKET_BITS // 8)
        bits[at : at + len(m)] = np.frombuffer(m, np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            bit = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((known[bit >> 3] >> (bit & 7)) & 1 > 0))
            if not batch.num_rows:
                continue
            data, offsets = wordhash.text_buffer(batch.column(1))
            for i, j, hashes, counts in shingles.sets(data, offsets, size):
                ends = np.concatenate(([0], np.cumsum(counts)))
                own = [hashes[ends[r] : ends[r + 1]] for r in range(j - i)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([_digest(x) for x in own], pa.binary()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), _longs(hashes))],
                    names=["digest", "set"],
                )

    rows = _rows(docs, id_col, text_col).withColumn("bit", F.pmod(F.xxhash64("id"), F.lit(BITMAP_BITS)))
    found = written(rows.mapInArrow(task, "digest binary, set array<long>"), "found-sets")
    return nodes.select("node", "digest").join(found, "digest").select("node", "set").dropDuplicates(["node"])


def _near(common: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * common >= percent * (n_a + n_b - common)


def _collide(pairs: DataFrame, sigs: DataFrame, matches: int, percent: int) -> DataFrame:
    """(a, b, n_a, n_b): the pairs of classes whose sizes allow the similarity and whose signatures collide often enough."""
    for x in "ab":
        pairs = pairs.join(sigs.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")), x)
    hits = F.aggregate(F.zip_with("sig_a", "sig_b", lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, h: s + h)
    return pairs.where((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")) & (hits >= matches)).select("a", "b", "n_a", "n_b")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are near."""
    for x in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(x), F.col("set").alias(f"set_{x}")), x)
    common = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.where(_near(common, F.col("n_a"), F.col("n_b"), percent)).select("a", "b")


def _cross_block(percent: int):
    """Joins the components of the minority of a long list to those of one block of the list; both come with sets and earlier postings.

    Pairs of labels (a, b) come back: each label that near pairs of this block join to others
    with the majority's, or else with the smallest of those.
    """

    def flat(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        counts = column.map(len).to_numpy()
        return (np.concatenate(column.to_list()) if len(column) else np.zeros(0, np.int64)), np.concatenate(([0], np.cumsum(counts)))

    def marks(values: np.ndarray, at: np.ndarray, known: np.ndarray) -> np.ndarray:
        where = np.minimum(np.searchsorted(known, values), len(known) - 1)
        hit = known[where] == values
        out = np.zeros((len(at) - 1, len(known)), np.float32)
        out[np.repeat(np.arange(len(at) - 1), np.diff(at))[hit], where[hit]] = 1
        return out

    def task(block: pd.DataFrame, few: pd.DataFrame) -> pd.DataFrame:
        links_a = links_b = np.zeros(0, np.int64)
        if len(block) and len(few):
            n_all, n_few = block["n"].to_numpy(), few["n"].to_numpy()
            seen, seen_at = flat(few["earlier"])
            known = np.unique(seen)
            labels, places = np.unique(np.concatenate((few["label"].to_numpy(), block["label"].to_numpy())), return_inverse=True)
            of_few, of_block = places[: len(few)], places[len(few) :]
            joined = np.arange(len(labels))  # the component of each label, as far as this block has joined them
            open_pairs = 100 * np.minimum(n_few[:, None], n_all) >= percent * np.maximum(n_few[:, None], n_all)
            # a pair is met on both sides if both are of the minority: once is enough
            both = few["node"].to_numpy()[:, None] < block["node"].to_numpy()[None, :]
            open_pairs &= both | ~block["few"].to_numpy()[None, :]
            if len(known):
                other, other_at = flat(block["earlier"])
                open_pairs &= (marks(seen, seen_at, known) @ marks(other, other_at, known).T) == 0
            values, at = flat(block["set"])
            own = few["set"].to_list()
            for i in range(len(few)):
                there = joined[of_block]
                apart = open_pairs[i] & (there != joined[of_few[i]])
                if not apart.any():
                    continue
                mine = np.sort(own[i])
                where = np.minimum(np.searchsorted(mine, values), len(mine) - 1)
                common = np.add.reduceat((mine[where] == values).astype(np.int64), at[:-1])
                near = np.flatnonzero(apart & (100 * common >= percent * (n_few[i] + n_all - common)))
                joined[np.isin(joined, there[near])] = joined[of_few[i]]
            _, first, which = np.unique(joined, return_index=True, return_inverse=True)
            root = first[which]
            for major in of_block[~block["few"].to_numpy()][:1]:
                root[joined == joined[major]] = major
            moved = root != np.arange(len(labels))
            links_a, links_b = labels[moved], labels[root[moved]]
        return pd.DataFrame({"a": links_a, "b": links_b}, dtype="int64")

    return task


def _long_lists(lists: DataFrame, postings: DataFrame, sets: DataFrame, percent: int, most: int | None = None) -> DataFrame:
    """Pairs of labels of components that near classes of one long list join; nothing but these leaves the blocks.

    lists: (token, size); postings: (token, node, n, earlier, label).  The component with
    the most classes of a list is its majority, all others its minority.  The minority meets
    `most` blocks of the list, or all.
    """
    members = postings.join(lists, "token")
    largest = members.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(F.max(F.struct("k", "label")).alias("m"))
    minority = members.join(largest.select("token", F.col("m.label").alias("major")), "token").withColumn("few", F.col("label") != F.col("major"))
    n_few = minority.where("few").groupBy("token").agg(F.count(F.lit(1)).alias("n_few"))
    rows = minority.join(n_few, "token").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("parts", F.ceil(F.col("n_few") / BLOCK).cast("int"))
    rows = rows.withColumn("here", F.pmod(F.xxhash64("node", "token"), F.col("blocks")).cast("int"))
    if most is not None:
        rows = rows.where(F.col("few") | (F.col("here") < most)).withColumn("blocks", F.least("blocks", F.lit(most)))
    rows = rows.join(sets, "node")
    part = F.pmod(F.xxhash64("token", "node"), F.col("parts")).cast("int")
    columns = ["token", "block", "part", "node", "n", "label", "few", "earlier", "set"]
    block = rows.where("here < blocks").withColumn("block", F.col("here")).withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select(columns)
    few = rows.where("few").withColumn("part", part).withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).select(columns).toDF(*columns)
    key = ["token", "block", "part"]
    return block.groupBy(key).cogroup(few.groupBy(key)).applyInPandas(_cross_block(percent), "a long, b long")


def _relabelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with the label of what their component has become; labels: (node, label) of labels."""
    up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
    return rows.join(up, "label", "left").withColumn("label", F.coalesce("up", "label")).drop("up")


def _wide(lists: DataFrame, postings: DataFrame) -> DataFrame:
    """Those of the lists (token, size) whose minority has more than BLOCK classes."""
    parts = postings.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg((F.sum("k") - F.max("k")).alias("n_few"))
    return parts.where(F.col("n_few") > BLOCK).select("token").join(lists, "token")


def groups(docs: DataFrame, size: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_shingles, component_id (the smallest id of its group), kept (whether it is that one).

    A null or empty text has no shingles and is alone; a text of fewer words than `size` is
    one shingle.  Rows that repeat an id with one text all get the same result; a null id
    never is a component_id unless the whole group has none.  An empty table gives no rows.
    """
    rows = written(signatures(docs, size, coordinates, id_col, text_col), "signatures")
    classes = written(_classes(rows), "classes")
    # the row of the smallest id stands for its class; copies have ids of their own, so none of them crowd one key
    at = F.coalesce("id", F.lit(-(1 << 63))).alias("at")
    nodes = classes.select("digest", at, "node").join(rows.where("n > 0").select("digest", at, "n", "sig"), ["digest", "at"]).dropDuplicates(["node"]).select("node", "n", "sig")

    tokens = nodes.select("node", F.explode("sig").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rank = Window.partitionBy("node").orderBy("df", "token")
    # postings that no other class shares come first in every class's order and need no list
    alone = coordinates - F.count(F.lit(1)).over(Window.partitionBy("node"))
    prefix = tokens.join(shared, "token").withColumn("rank", F.row_number().over(rank)).withColumn("alone", alone).where(F.col("rank") + F.col("alone") <= coordinates - matches + 1)
    prefix = written(prefix.select("token", "node", "df"), "postings")
    lists = written(prefix.groupBy("token").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub")).where("size > 1"), "lists")
    in_lists = prefix.join(lists.select("token"), "token", "left_semi").select("node").distinct()
    sigs = written(nodes.join(in_lists, "node", "left_semi"), "list-signatures")

    stars = prefix.join(lists, "token").where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    stars = written(_collide(stars, sigs, matches, percent), "stars")
    asked = written(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "asked")
    sets = written(_sets(docs, classes.join(asked, "node"), size, id_col, text_col), "sets")
    links = written(_confirm(stars, sets, percent), "links")
    labels = connected_components(links)

    labelled = prefix.join(labels, "node", "left").select("token", "node", "df", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("token").join(lists, "token")
    mixed = written(mixed, "mixed")
    short, long = mixed.where(F.col("size") <= SHORT_LIST), mixed.where(F.col("size") > SHORT_LIST).select("token", "size")
    labelled = written(labelled.join(mixed.select("token"), "token", "left_semi"), "labelled")
    left = labelled.join(short.select("token", "hub"), "token").where("node <> hub").select("token", F.col("node").alias("a"), F.col("label").alias("la"))
    right = labelled.select("token", F.col("node").alias("b"), F.col("label").alias("lb"))
    # the hub has been compared with all others of its list already
    pairs = left.join(right, "token").where("a < b and la <> lb").select("a", "b").distinct()
    pairs = written(_collide(pairs, sigs, matches, percent), "pairs")
    members = labelled.join(long, "token", "left_semi").select("node").distinct()
    # only classes in a list that is both long and mixed need the other postings before that list
    order = Window.partitionBy("node").orderBy("df", "token").rowsBetween(Window.unboundedPreceding, -1)
    before = prefix.join(members, "node", "left_semi").withColumn("earlier", F.coalesce(F.collect_list("token").over(order), F.array())).join(long.select("token"), "token", "left_semi")
    posted = written(before.join(sigs.select("node", "n"), "node").join(labels, "node", "left").select("token", "node", "n", "earlier", F.coalesce("label", "node").alias("label")), "long-postings")
    more = written(pairs.select(F.explode(F.array("a", "b")).alias("node")).unionByName(members).distinct().join(asked, "node", "left_anti"), "asked-more")
    sets = sets.unionByName(written(_sets(docs, classes.join(more, "node"), size, id_col, text_col), "more-sets"))
    wide = written(_wide(long, posted), "wide-lists")
    if not wide.isEmpty():
        joined = written(_long_lists(wide, posted, sets, percent, most=1).distinct(), "first-blocks")
        links = links.unionByName(joined)
        posted = written(_relabelled(posted, connected_components(joined)), "long-postings")
    found = _confirm(pairs, sets, percent).unionByName(_long_lists(long, posted, sets, percent).distinct())
    labels = connected_components(links.unionByName(written(found, "more-links")))

    marked = classes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    first = marked.groupBy("label").agg(F.min("id").alias("component_id"))
    of_class = marked.join(first, "label").select("digest", "component_id")
    found = rows.select("id", "n", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
