"""Orchard codes, length-stratified search and budgeted mixes against brute force, with odd rows."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from planwalk.llm import lexical, mixing, orchard, wordhash

VECTORS = "vec_id long, embedding array<double>, label string, code string, id long"
DOCS = "doc_id long, text string, source string, size long, id long"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, label, "clash", 1) for i, v, label in rows], VECTORS)


def plain_codes(rows, parts, entries, rounds, scale=256):
    """Every point against every entry, in Python's integers."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for width in {len(r[1]) for r in rows}:
        own = [(i, [math.floor(x * scale) if math.isfinite(x * float(scale)) else int(x) * scale for x in v], label) for i, v, label in rows if len(v) == width]
        spans, first = orchard.bounds(width, parts), {}
        for i, v, _ in sorted(((i, v, 0) for i, v, _ in own if i is not None), key=lambda r: (r[0], r[1])):
            first.setdefault(i, v)
        books = [[v[a:b] for v in list(first.values())[:entries]] for a, b in spans]
        if not first:
            out += [(i, None, None, label) for i, _, label in own]
            continue

        def nearest(v, books=books, spans=spans):
            return [min((sum((x - y) ** 2 for x, y in zip(v[a:b], e, strict=True)), k) for k, e in enumerate(book)) for book, (a, b) in zip(books, spans, strict=True)]

        for _ in range(rounds):
            codes = [nearest(v, books) for _, v, _ in own]
            for p, (a, b) in enumerate(spans):
                for k in range(len(books[p])):
                    mine = [v[a:b] for (_, v, _), c in zip(own, codes, strict=True) if c[p][1] == k]
                    if mine:
                        books[p][k] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
        for i, v, label in own:
            found = nearest(v, books)
            out.append((i, "".join(f"{k:02x}" for _, k in found), min(sum(d for d, _ in found), 2**63 - 1), label))
    totals = collections.Counter()
    for _, _, error, label in out:
        totals[label] += error or 0
    known = {label for _, _, e, label in out if e is not None}
    return sorted(((i, c, e, min(totals[label], 2**63 - 1) if label in known else None) for i, c, e, label in out), key=str)


def codes(spark, rows, **kw):
    found = orchard.quantize(vectors_of(spark, rows), **kw)
    return sorted(((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in found.collect()), key=str)


def test_codes_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(k, [round(rng.gauss(0, 1), 2) for _ in range(8)], rng.choice(["a", "b", None])) for k in range(150)]
    rows += [rows[5], rows[5], (5, [9.0] * 8, "b"), (None, [0.5] * 8, None), (-4, None, "a"), (-3, [None] * 8, "a"), (-2, [math.nan] * 8, "a"), (-1, [math.inf] * 8, "a")]
    rows += [(900, [], "c"), (901, [1.0] * 6, "c"), (902, [-1.0] * 6, "a"), (None, [1.0] * 5, "d")]
    assert codes(spark, rows, parts=4, entries=10) == plain_codes(rows, 4, 10, 2)


@pytest.mark.parametrize("large", [1e9, 1e30, 1e300, 1.7e308])
def test_codes_of_large_components(spark, large):
    rng = random.Random(5)
    rows = [(k, [rng.uniform(-large, large) for _ in range(4)], "x") for k in range(40)] + [(100 + k, [rng.uniform(-1, 1) for _ in range(4)], None) for k in range(9)]
    assert codes(spark, rows, parts=2, entries=6) == plain_codes(rows, 2, 6, 2)


def test_codes_of_nothing_and_of_few(spark):
    assert codes(spark, []) == []
    found = orchard.quantize(vectors_of(spark, [(1, [0.25] * 16, None)])).first()
    assert (found["code"], found["error"], found["label_error"]) == ("00" * 16, 0, 0)
    book = orchard.train(vectors_of(spark, [(k, [k / 256.0] * 16, None) for k in range(5)]))[0]
    assert book.decode("03" * 16) == [3] * 16
    with pytest.raises(ValueError):
        orchard.train(vectors_of(spark, []), entries=257)


def test_search_of_lists_looks_at_few_entries_and_finds_the_nearest():
    rng = np.random.default_rng(1)
    entries = rng.integers(-50, 50, (64, 4))
    entries[40] = entries[7]  # a tie
    points = np.concatenate((rng.integers(-60, 60, (3000, 4)), entries))
    now, best = orchard.Lists(entries).nearest(points)
    squares = ((points[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (now == squares.argmin(axis=1)).all() and (best == squares.min(axis=1)).all()


# ---- ranked search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def plain_rank(docs, items, k):
    bags = [(i, collections.Counter(terms(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n_docs, length = len(bags), sum(sum(b.values()) for _, b in bags)
    df = collections.Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        scores = []
        for i, b in bags:
            m = 75 + 25 * sum(b.values()) * n_docs // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 12 * m)) for w in terms(text) if b[w])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        out += [(item, r + 1, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def ranked(spark, docs, items, k):
    d = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in docs], DOCS)
    q = spark.createDataFrame([(i, t, 7, 8) for i, t in items], "item_id long, text string, rank int, score int")
    return sorted((tuple(r[c] for c in ("item_id", "rank", "doc_id", "score")) for r in lexical.rank(d, q, k).collect()), key=str)


@pytest.mark.parametrize(("postings", "docs", "block", "most"), [(2_000_000, 65_536, 200_000, 1 << 21), (300, 40, 20, 1 << 21), (2_000_000, 50, 200_000, 3)])
def test_ranks_equal_brute_force(spark, monkeypatch, postings, docs, block, most):
    for name, x in (("SHARD_POSTINGS", postings), ("SHARD_DOCS", docs), ("BLOCK_TERMS", block), ("MOST_TERMS", most)):
        monkeypatch.setattr(lexical, name, x)
    rng = random.Random(9)
    words = [f"w{k}" for k in range(60)] + ["É", "straße", "X" * 70, "longer-than", "eightchars9"]
    some = lambda n: " ".join(rng.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=n))
    rows = [(k, some(rng.randint(1, 30))) for k in range(200)]
    rows += [(300 + k, "W1 w2, w3;w4") for k in range(60)]  # one group of copies
    rows += [(7, rows[7][1]), (7, "w1 w1 w9"), (None, "w1 w2 w3 w4"), (501, None), (502, ""), (503, " \n--"), (504, some(3000))]
    items = [(k, some(rng.randint(1, 12))) for k in range(12)] + [(1, "w1 w1 w1 w2"), (90, None), (91, ""), (92, "none-of-these"), (93, "w1 w2 w3 w4"), (93, "w1 w2 w3 w4"), (None, "w9")]
    assert ranked(spark, rows, items, 8) == plain_rank(rows, items, 8)


def test_ranks_of_nothing(spark):
    assert ranked(spark, [], [(1, "a")], 5) == []
    assert ranked(spark, [(1, "a b")], [], 5) == []
    assert ranked(spark, [(1, None), (2, "")], [(1, "a")], 5) == []


def test_long_texts_are_counted_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(wordhash, "SEGMENT_BYTES", 64)
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choices(["a", "bb", "ccc", "d" * 90, "é"], k=rng.randint(0, 300)))) for k in range(20)] + [(50, "z" * 5000), (51, " " * 500 + "a")]
    found = lexical.counted(spark.createDataFrame(rows, "id long, t string"), "t", None).collect()
    wanted = {i: collections.Counter(terms(t)) for i, t in rows}
    for r in found:
        assert r["n"] == sum(wanted[r["id"]].values()) and sorted(r["tfs"]) == sorted(wanted[r["id"]].values())


# ---- mixes


def reachable(sizes):
    sums = {0}
    for s in sizes:
        sums |= {x + s for x in sums}
    return sums


def test_sums_are_the_nearest_and_keep_their_counts():
    rng = random.Random(4)
    for _ in range(300):
        sizes = np.array(sorted(rng.sample(range(0, 40), rng.randint(1, 6))))
        counts = np.array([rng.randint(0, 3) for _ in sizes])
        budget = rng.choice([rng.uniform(0, 150), rng.randint(0, 100), rng.randint(0, 50) + 0.5])
        fit = mixing.nearest_sum(sizes, counts, budget)
        assert (fit >= 0).all() and (fit <= counts).all()
        all_sums = reachable([s for s, c in zip(sizes.tolist(), counts.tolist(), strict=True) for _ in range(c)])
        assert abs((sizes * fit).sum() - budget) == min(abs(s - budget) for s in all_sums)


def test_plan_of_many_documents_meets_its_target(monkeypatch):
    monkeypatch.setattr(mixing, "SUMS", 1 << 12)
    sizes, counts = np.arange(0, 9000, 7), np.full(1286, 1_000_000_000)
    for target in (0.0, 1e6 + 0.25, 3.3e15, 6.1e15, float(2 * (sizes * counts).sum())):
        times, take = mixing.plan(sizes, counts, target, 2)
        assert abs(times * int((sizes * counts).sum()) + int((sizes * take).sum()) - target) <= 4 and (take <= counts).all() and (times < 2 or not take.any())


def plain_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(names)}
    goal, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        open_ = [s for s in names if s not in stopped]
        left = goal - sum(2 * sizes[s] for s in stopped)
        t = {s: w[s] * left / sum(w[x] for x in open_) for s in open_} | {s: 2 * sizes[s] for s in stopped}
        over = {s for s in open_ if t[s] > 2 * sizes[s]}
        if not over:
            return t
        stopped |= over


def mix_rows(spark, rows, n=3):
    d = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], DOCS).repartition(n)
    return sorted((tuple(r) for r in mixing.mix(d).select("doc_id", "source", "size", "source_size", "target", "taken").collect()), key=str)


@pytest.mark.parametrize(("bucket", "copies"), [(32_768, 16_384), (8, 5)])
def test_mix_meets_targets_and_reruns_agree(spark, monkeypatch, bucket, copies):
    monkeypatch.setattr(mixing, "BUCKET", bucket)
    monkeypatch.setattr(mixing, "COPIES", copies)
    rng = random.Random(11)
    rows = [(k, " ".join("x" * rng.randint(1, 3) for _ in range(rng.choice([0, 1, 3, 3, 3, 8, 40]))), rng.choice(["hot"] * 6 + ["b", "B", "é", "", "tiny", None])) for k in range(400)]
    rows += [(1000, "one row many times", "hot")] * 60 + [(None, "a\tb\x0bc\x1cd", "z")] * 3 + [(1001, None, "z"), (1002, " \n", None), (1003, None, "empty")]
    found = mix_rows(spark, rows)
    assert found == mix_rows(spark, rows, 5)
    size_of = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert collections.Counter((i, s, z) for i, s, z, *_ in found) == collections.Counter((i, s, size_of(t)) for i, t, s in rows)
    sizes, taken = collections.Counter(), collections.Counter()
    for _, source, size, _, _, t in found:
        sizes[source] += size
        taken[source] += t
        assert t in (0, size, 2 * size)
    targets = plain_targets(sizes)
    for _, source, _, whole, target, _ in found:
        assert whole == sizes[source] and target == pytest.approx(targets[source], rel=1e-12)
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)


def test_mixed_documents_stand_as_often_as_they_are_taken(spark):
    rows = [(k % 50, f"t{k % 50} " * (k % 7), "a" if k % 3 else None) for k in range(120)] + [(99, "same", "a")] * 7
    d = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in rows], DOCS)
    want = collections.Counter()
    for r in mixing.mix(d).collect():
        want[r["doc_id"], r["source"]] += r["taken"]
    got = collections.Counter()
    for r in mixing.mixed(d).collect():
        got[r["doc_id"], r["source"]] += len(r["text"].split())
    assert +got == +want and mixing.mixed(d).columns == d.columns


def test_mix_of_nothing(spark):
    assert mix_rows(spark, []) == []
    assert [r[2:] for r in mix_rows(spark, [(1, None, None), (2, "", "a")])] == [(0, 0, 0.0, 0)] * 2


def test_many_sources_keep_their_order(spark):
    rows = spark.range(3000).select(F.concat(F.lit("s"), F.col("id")).alias("source"), F.lit(1).alias("source_size"))
    found = {r["source"]: r["at"] for r in mixing.numbered(rows).collect()}
    assert found == {s: k for k, s in enumerate(sorted(found))}
