"""The language_id stage: what no learned language explains goes, clean texts of any length stay, whatever the columns are called."""

import math

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from planwalk.llm import langid, wordhash

SMALL = "/root/testdata/sf0.001"

NOISE = ["qX9zRk2LmP7vT4w" * 40, "0b3f9a77c1de" * 50, "Привет как дела сегодня " * 20, "今日は良い天気です" * 30]


def test_noise_goes_and_prose_stays(spark):
    real = spark.read.parquet(f"{SMALL}/documents.parquet")
    whole = real.where("text is not null")
    texts = [(1_000_000 + k, t, "en", "noise", len(t or "")) for k, t in enumerate([*NOISE, None, "", "12 $$"])]
    texts += [(2_000_000, "the and of", "en", "short", 10), (2_000_000, "the and of", "en", "short", 10)]
    # without a label, so that noise is not learned from
    noise = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string, n_chars long").withColumn("lang", F.when(F.col("source") == "short", F.col("lang")))
    docs = real.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).unionByName(noise)
    for clash in ("score", "_gain", "lang_pred", "_LANG"):
        docs = docs.withColumn(clash, F.lit("own"))
    found = corpus_pipeline.language_id(spark, docs, "")
    assert found.columns == docs.columns
    rows = found.collect()
    assert all(r[c] == "own" for r in rows for c in ("score", "_gain", "lang_pred", "_LANG"))
    assert not [r for r in rows if r["source"] == "noise"]
    assert sum(r["source"] == "short" for r in rows) == 2
    assert sum(r["source"] not in ("noise", "short") for r in rows) == whole.count()
    assert corpus_pipeline.language_id(spark, docs.where("false"), "").count() == 0


def test_least_gain_keeps_what_labelled_texts_look_like(spark):
    real = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = langid.train(real)
    assert langid.least_gain(real, model) == 0.0  # never above chance
    assert langid.least_gain(real.where("false"), model) == 0.0
    odd = real.limit(1).select(F.lit("+1 (654) 555-4136 4397110767823743 of 53.121.55.90").alias("text"), F.lit("en").alias("lang"))
    (row,) = langid.predict(odd, model).collect()
    assert langid.least_gain(odd, model) == min(0.0, row["gain"] - langid.MARGIN)


def test_gain_is_the_mean_log_ratio_to_chance(spark):
    model = langid.train(spark.createDataFrame([("aab aab", "x"), ("ccd", "y")], "text string, lang string"))
    docs = spark.createDataFrame([("aab",), ("zzzz qq",), (None,), ("77",)], "text string")
    got = {r["text"]: r for r in langid.predict(docs, model).collect()}
    for text in ("aab", "zzzz qq"):
        buckets = [b for _, _, found in langid.grams(*wordhash.text_buffer(pa.array([text]))) for part, _ in found for b in part.tolist()]
        k = model.languages.index(got[text]["lang_pred"])
        assert math.isclose(got[text]["gain"], sum(model.log_p[b, k] for b in buckets) / len(buckets) + math.log(langid.BUCKETS), abs_tol=1e-9)
    assert got["aab"]["gain"] > got["zzzz qq"]["gain"]
    assert got[None]["gain"] is None and got["77"]["gain"] is None
