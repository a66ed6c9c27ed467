"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns what the
next one gets as docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planwalk.llm import decontaminate, langid, linededup, neardup, packing
from planwalk.llm.store import fresh
from planwalk.sources.scratch import written

#: A document stays if its language is found with at least this posterior probability.
LEAST_SCORE = 0.5
SHINGLE_WORDS = 5
PERCENT = 80
WINDOW = 10
ROOM = 1024
END_ID = 2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages learned from the rows that are not held out; null texts, texts without a letter, doubtful ones and those that no learned language explains (a mean over n-grams, calibrated on labelled texts) go.

    Empty tables give no rows, and so do tables without a labelled text to learn from; repeated
    rows all stay or all go.  Whole texts of any length are looked at, and nothing else.
    """
    names = lang, score, gain = fresh(docs, "lang", "score", "gain")
    labelled = docs.where(~langid.held_out())
    model = langid.train(labelled)
    least = langid.least_gain(labelled, model)
    found = langid.predict(docs, model, names=tuple(names))
    return found.where((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= LEAST_SCORE) & (F.col(gain) >= least)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand, to within a few edits, earlier in the corpus are taken out; n_chars, where there is one, follows the text.

    Of equal lines the one in the smallest document id stays, and of rows that repeat id and
    text each keeps the same lines.  Null texts stay null, all columns stay, and so do all
    rows but those that had a text and lost all its lines.
    """
    kept = linededup.apply(docs)
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id, null ids last, and of equal ids the one with the smallest row key.

    A row is known by its key, a hash of id and text, so rows that share an id, or have none,
    are told apart by their texts.  Of rows that repeat id and text, the one whose other
    columns, of any type, come first when written as JSON stays.
    """
    (key,) = fresh(docs, "key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    # repeated rows have one key: both sides are made distinct, so no key meets itself many times
    group = neardup.groups(keyed, size=SHINGLE_WORDS, percent=PERCENT, id_col=key).select(key, "component_id").distinct()
    ids = keyed.select(key, "doc_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", key))
    kept = ids.join(group, key).groupBy("component_id").agg(first.alias("first")).select(F.col("first")[key].alias(key)).distinct()
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = keyed.join(kept, key, "left_semi")
    if not rest:
        return rows.select(*docs.columns).distinct()
    # columns are renamed inside, so that none clashes with another
    others = F.struct(*(F.col(c).alias(f"c{n}") for n, c in enumerate(rest)))
    rows = rows.groupBy("doc_id", "text").agg(F.min_by(others, F.to_json(others)).alias("rest"))
    found = {c: F.col("rest")[f"c{n}"].alias(c) for n, c in enumerate(rest)}
    return rows.select(*(found.get(c, F.col(c)) for c in docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; of rows that repeat id and text all stay or all go, null texts stay."""
    return decontaminate.drop_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), WINDOW)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of every document with its place in a sequence of ROOM tokens."""
    return packing.best_fit(docs, public_tokenizers.path("byte_bpe_50k.json"), END_ID, ROOM)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenizers, MinHash and naive Bayes have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
