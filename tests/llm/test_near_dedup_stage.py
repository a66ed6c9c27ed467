"""The near_dedup stage against brute force, with null ids, repeated ids and repeated rows."""

import random

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from planwalk.llm import neardup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    words = (text or "").split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def groups_of(rows):
    """Groups of (doc_id, text) by single links of similarity 0.8; wordless texts are alone."""
    rows, groups = sorted(set(rows), key=str), []
    for row in rows:
        own = shingle_set(row[1])
        near = [g for g in groups if own and any(100 * len(own & s) >= 80 * len(own | s) for s in (shingle_set(t) for _, t in g))]
        groups = [g for g in groups if g not in near] + [[row] + [x for g in near for x in g]]
    return groups


def test_near_dedup_equals_brute_force(spark):
    rng = random.Random(11)
    prose = lambda: " ".join(f"w{rng.randrange(5000)}" for _ in range(60))
    near = lambda t: " ".join(t.split()[:-1] + [f"z{rng.randrange(5000)}"])
    a, b, c, d, e = (prose() for _ in range(5))
    pairs = [(None, prose()) for _ in range(6)]  # clean documents without an id
    pairs += [(7, prose()) for _ in range(3)]  # clean documents that share an id
    pairs += [(None, a), (3, near(a)), (None, near(a)), (9, a)]  # an id goes before none
    pairs += [(None, b), (None, near(b)), (None, b)]
    pairs += [(7, c), (7, near(c)), (1, d), (2, d), (5, e), (5, e)]
    pairs += [(20, None), (20, ""), (21, ""), (None, ""), (None, None)]
    rows = [(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(pairs)]
    rng.shuffle(rows)
    found = [tuple(r) for r in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, DOCS), "").collect()]
    assert len(found) == len({r[:2] for r in found})
    groups = groups_of(pairs)
    assert len(found) == len(groups)
    for group in groups:
        (kept,) = [r for r in found if r[:2] in group]
        assert kept[0] == min((i for i, _ in group if i is not None), default=None)
        assert kept == min((r for r in rows if r[:2] == kept[:2]), key=lambda r: r[2:])
    # which row stays does not depend on the order or the split of the rows
    again = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows[::-1], DOCS).repartition(3), "")
    assert sorted(map(str, (tuple(r) for r in again.collect()))) == sorted(map(str, found))


def test_blocks_return_forests():
    """Of a group of near copies a block returns one pair for each component that it joins, not one for each near pair."""
    base = np.arange(100)
    sets = [np.concatenate((base, [1000 + k])) for k in range(60)] + [np.arange(5000 + 100 * k, 5101 + 100 * k) for k in range(0, 20, 2)]
    rows = pd.DataFrame({"node": np.arange(70), "n": 101, "label": np.arange(70), "few": np.arange(70) > 0, "set": sets, "earlier": [np.zeros(0, np.int64)] * 70})
    rows.loc[58:59, "label"] = 58  # joined before
    links = neardup._cross_block(80)(rows, rows[rows["few"]])
    assert len(links) == 58
    reached, grown = {0}, True
    while grown:
        grown = {b for pair in links[["a", "b"]].itertuples(index=False) if reached & set(pair) for b in pair} - reached
        reached |= grown
    assert reached == set(range(59))


@pytest.mark.parametrize("block", [8, 30, 1000])
def test_long_lists_equal_brute_force(spark, monkeypatch, block):
    """Groups that no single document is near to: a chain of variants and a star of them, over lists of several blocks."""
    monkeypatch.setattr(neardup, "SHORT_LIST", 4)
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(block)
    base = [f"w{k}" for k in range(150)]
    texts = []
    for k in range(60):  # moves away from the base, a few words at a time
        texts.append(" ".join(f"c{(k - i) // 60}" if i <= k else w for i, w in enumerate(base)))
    for _ in range(80):
        w = list(base)
        for _ in range(rng.randint(1, 12)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in neardup.groups(docs).collect()}
    expected = {i: min(i for i, _ in group) for group in groups_of(list(enumerate(texts))) for i, _ in group}
    assert got == expected
