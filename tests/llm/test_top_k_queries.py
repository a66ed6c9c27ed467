"""Top-k where rows repeat: queries of one id, in one and in several shards and regions."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from planwalk.llm import topk


def brute(rows, k, steps=1024):
    """Every query row's list, with candidates counted as often as they stand."""
    whole = [(i, [math.floor(Fraction(x) * steps) for x in v]) for i, v in rows]
    out = []
    for q, v in whole:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in whole if c != q and len(w) == len(v))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize(("shard", "regions", "boxes"), [(16_384, 1024, 1 << 21), (20, 1024, 1 << 21), (15, 4, 8), (15, 1, 1 << 21)])
def test_repeated_queries_have_their_lists(spark, monkeypatch, shard, regions, boxes):
    for name, x in (("SHARD_ROWS", shard), ("REGIONS", regions), ("BOXES", boxes)):
        monkeypatch.setattr(topk, name, x)
    rng = np.random.default_rng(11)
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate((rng.normal(size=(60, 4)) + 4, rng.normal(size=(60, 4)) - 4)).round(1))]
    rows += [rows[100]] * 2 + [(100, [1.0, 0.0, 0.0, -2.0]), (0, rows[100][1]), (7, rows[7][1]), (7, [9.0] * 4)]  # queries 100 and 0, candidate 7
    rows += [(500 + k, [2.5] * 4) for k in range(50)]  # a group of copies larger than a shard
    rows += [(900, [1.0, 2.0]), (900, [1.0, 2.0]), (901, [3.0, 1.0]), (902, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(c) for c in ("qid", "region", "copies", "floor")})
    got = sorted(tuple(r) for r in topk.top_k(df.repartition(5), F.col("vec_id") % 100 == 0, k=6).collect())
    assert got == brute([r for r in rows if r[1]], 6)


def test_regions_keep_far_shards_out(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(8, 3)) * 20
    rows = [(k, (centres[k % 8] + rng.normal(size=3) * 0.1).tolist()) for k in range(800)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    sent = []
    real = topk._reached

    def counted(*args, home, **kw):
        found = real(*args, home=home, **kw)
        if not home:
            sent.append(found.count())
        return found

    monkeypatch.setattr(topk, "_reached", counted)
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0, k=5).collect())
    assert got == brute(rows, 5) and sent[0] < 8 * 16 / 2  # of 8 queries and 16 regions


def test_splits_of_equal_and_of_skewed_samples():
    assert topk.Splits(np.ones((50, 3)), 8).n == 1 and topk.Splits(np.zeros((0, 3)), 8).n == 1
    rows = np.concatenate((np.zeros((90, 2)), np.arange(20).reshape(10, 2)))
    found = topk.Splits(rows, 4)
    assert 1 < found.n <= 4 and set(found.regions(rows).tolist()) == set(range(found.n))
