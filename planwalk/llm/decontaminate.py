"""Benchmark decontamination with DataFrame functions alone.

Words are the runs of [0-9a-z] and non-ASCII characters of the text with A-Z lower-cased.  A
benchmark item of at least `window` words has a window at each of its words that has enough
words after it; a shorter item is one window.  A broadcast hash set of the items' short
n-grams is probed by the n-grams at every `step`-th word of a document: any window, wherever
it starts, holds a whole n-gram at such a word.  A hit is then verified word by word, as far
to both sides as a window reaches, within the same pass, so only found spans leave the scan.

What is broadcast is bounded: items are cut into overlapping pieces of PIECE_WORDS words,
pieces are dealt into blocks of about BLOCK_WORDS words, and each block has one scan.  A
block's hash set has a row of three numbers per word, and its pieces hold each word once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwalk.llm.store import fresh, written

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same words in a text whose letters keep their case, and what lies between them.
WORDS_AS_WRITTEN = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words of a piece of an item, and words of the pieces that are broadcast at once: about 50 MB.
PIECE_WORDS = 4096
BLOCK_WORDS = 500_000


def split_words(text: Column) -> Column:
    """The words; the first and the last entry may be empty, no other."""
    return F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), SEPARATORS)


def n_words(words: Column) -> Column:
    last = F.when((F.size(words) > 1) & (F.element_at(words, -1) == ""), 1).otherwise(0)
    return (F.size(words) - F.when(F.element_at(words, 1) == "", 1).otherwise(0) - last).cast("long")


def _pieces(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """(pid, item, w, iw): the words of every item in pieces, each with the first words of the next so that it has all windows that start in it."""
    words = F.filter(split_words(F.col(text_col)), lambda w: w != "")
    items = benchmark.select(F.col(item_col).alias("item"), words.alias("all")).where(F.size("all") > 0).withColumn("w", F.least(F.size("all"), F.lit(window)))
    begins = F.expr(f"sequence(0, greatest(size(all) - w, 0), {PIECE_WORDS})")
    pieces = items.select("item", "w", "all", F.explode(begins).alias("at")).select("item", "w", F.expr(f"slice(all, at + 1, {PIECE_WORDS} + w - 1)").alias("iw")).distinct()
    return pieces.select(F.monotonically_increasing_id().alias("pid"), "item", "w", "iw")


def _gram(words: str, at: str, n: int) -> Column:
    return F.expr(f"xxhash64({', '.join(f'{words}[{at} + {k}]' for k in range(n))})")


def _found(docs: DataFrame, pieces: DataFrame, w: int) -> DataFrame:
    """(doc, text_key, item, low, high): word spans in which windows of w words of an item occur."""
    n = (w + 1) // 2
    reach = w - n
    seeds = pieces.select("pid", "item", "iw", F.explode(F.expr(f"sequence(0, size(iw) - {n})")).alias("q"))
    # of places of one item with the same words as far as a window reaches, one is enough
    around = F.expr(f"struct(least(q, {reach}) AS before, slice(iw, greatest(q - {reach}, 0) + 1, least(q, {reach}) + {n + reach}) AS words)")
    seeds = seeds.groupBy("item", _gram("iw", "q", n).alias("gram"), around.alias("around")).agg(F.min(F.struct("pid", "q")).alias("s")).select("gram", "s.pid", "s.q")
    scan = docs.select("doc", "text_key", "dw", F.explode(F.expr(f"CASE WHEN size(dw) >= {n} THEN sequence(0, size(dw) - {n}, {reach + 1}) ELSE array() END")).alias("p"))
    hits = scan.withColumn("gram", _gram("dw", "p", n)).join(F.broadcast(seeds), "gram").join(F.broadcast(pieces.select("pid", "item", "iw")), "pid")
    # unrolled, without lambdas, so that scan, joins and verification are one piece of generated code that hands on nothing but spans
    left, right = (_run(steps, sign) for steps, sign in ((range(1, reach + 1), "-"), (range(n + reach), "+")))
    spans = hits.select("doc", "text_key", "item", F.expr(f"p - ({left})").alias("low"), F.expr(f"p + ({right})").alias("high"))
    # a length that is an aggregate is not tested before the joins' rows are spans
    return spans.groupBy("doc", "text_key", "item", "low", "high").agg(F.max(F.col("high") - F.col("low")).alias("n")).where(F.col("n") >= w).drop("n")


def _run(steps: range, sign: str) -> str:
    """SQL of how many words from p and q on, to one side, are equal."""
    found = "0"
    for k in reversed(steps):
        found = f"IF(get(dw, p {sign} {k}) = get(iw, q {sign} {k}), 1 + {found}, 0)"
    return found


def find(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Spans of a document's words in which windows of a benchmark item occur; together they are all such words.

    Columns: doc, text_key (a hash of the text, so that rows which share an id stay apart),
    item, low, high (counted from 0 over split_words, high exclusive).  Documents and items
    that are null or have no word have no spans; items and texts may be of any length.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_key"), split_words(F.col(text_col)).alias("dw"))
    pieces = written(_pieces(benchmark, window, item_col, item_text_col), "benchmark-pieces")
    sizes = pieces.groupBy("w").agg(F.sum(F.size("iw")).alias("n")).collect()  # at most `window` rows
    found = None
    for size in sorted(sizes, key=lambda r: r["w"]):
        blocks = -(-size["n"] // BLOCK_WORDS)
        for b in range(blocks):
            part = pieces.where(F.col("w") == size["w"])
            one = _found(rows, part if blocks == 1 else part.where(F.pmod(F.xxhash64("pid"), F.lit(blocks)) == b), size["w"])
            found = one if found is None else found.unionByName(one)
    if found is None:
        found = rows.select("doc", "text_key", F.lit(None).cast(pieces.schema["item"].dataType).alias("item"), F.lit(0).alias("low"), F.lit(0).alias("high")).where("false")
    return found


def report(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_words, n_hit, n_items, items (sorted as strings), spans (merged word spans), contaminated.

    Repeated rows each get their row; a null text has no words.
    """
    spans = find(docs, benchmark, window, id_col, text_col, item_col, item_text_col)
    order = Window.partitionBy("doc", "text_key").orderBy("low", "high")
    reach = F.coalesce(F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = spans.withColumn("_from", F.greatest(F.col("low"), reach))
    found = fresh.groupBy("doc", "text_key").agg(
        F.sum(F.greatest(F.col("high") - F.col("_from"), F.lit(0))).cast("long").alias("n_hit"),
        F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"),
        F.array_sort(F.collect_set(F.when(F.col("high") > F.col("_from"), F.struct(F.col("_from").alias("low"), "high")))).alias("spans"),
    )
    words = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), n_words(split_words(F.col(text_col))).alias("n_words"))
    same = F.col("id").eqNullSafe(F.col("doc")) & (F.col("key") == F.col("text_key"))
    return words.join(found, same, "left").select(
        F.col("id").alias(id_col),
        F.col("key").alias("text_key"),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        "spans",
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def drop_documents(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents in which no window of the benchmark occurs, with all their columns, whatever their names."""
    d, k = fresh(docs, "d", "k")
    hit = find(docs, benchmark, window, id_col, text_col, item_col, item_text_col).select(F.col("doc").alias(d), F.col("text_key").alias(k)).distinct()
    return docs.join(hit, F.col(id_col).eqNullSafe(F.col(d)) & (F.xxhash64(text_col) == F.col(k)), "left_anti")


def cut_spans(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """All documents with the hit words, and what separates them from the words before, cut out of text_col; other texts and all other columns stay as they are."""
    d, k, s = fresh(docs, "d", "k", "s")
    spans = report(docs, benchmark, window, id_col, text_col, item_col, item_text_col).where("contaminated").select(F.col(id_col).alias(d), F.col("text_key").alias(k), F.col("spans").alias(s)).dropDuplicates([d, k])
    text = F.col(text_col)
    joined = docs.join(spans, F.col(id_col).eqNullSafe(F.col(d)) & (F.xxhash64(text_col) == F.col(k)), "left")
    # split_words counts an empty first entry where the text starts with a separator
    skip = F.when(F.element_at(split_words(text), 1) == "", 1).otherwise(0)
    words = F.regexp_extract_all(text, F.lit(WORDS_AS_WRITTEN), F.lit(0))
    between = F.split(text, WORDS_AS_WRITTEN)
    kept = F.transform(
        words,
        lambda w, i: F.when(F.exists(s, lambda x: (i + skip >= x["low"]) & (i + skip < x["high"])), F.lit("")).otherwise(F.concat(F.get(between, i), w)),
    )
    cut = F.concat(F.array_join(kept, ""), F.element_at(between, -1))
    return joined.withColumn(text_col, F.when(F.col(s).isNotNull(), cut).otherwise(text)).select(*docs.columns)
