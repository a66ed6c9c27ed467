"""Bytes of archives on disk, archives of other writers, and verdicts on urls against brute force."""

import gzip
import math
import random
import time
import urllib.parse
import zlib

import pytest
from pyspark.sql import functions as F

from planwalk.llm import store, urlfilter, warc
from test_corpus_operators import brute_scores


def local(uri):
    return urllib.parse.unquote(uri.removeprefix("file://"))


def cut_into_members(raw):
    """Contents of the gzip members of a file, by zlib alone."""
    out = []
    while raw:
        one = zlib.decompressobj(31)
        out.append(one.decompress(raw) + one.flush())
        assert one.eof
        raw = one.unused_data
    return out


def test_files_hold_one_member_a_record(spark):
    rows = [(k, f"http://a/{k}", "é" * (400 * (k % 5))) for k in range(40)]
    out = store.scratch(spark, "warc")
    manifest = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), out).collect()
    seen = []
    for r in manifest:
        raw = open(local(r["path"]), "rb").read()
        found = cut_into_members(raw)
        assert len(raw) == r["n_bytes"] and len(found) == r["n_records"]
        for content in found:
            assert content.startswith(b"WARC/1.1\r\n") and content.count(b"WARC/1.1\r\n") == 1
            seen.append(warc.parse(content)["page_id"])
        assert gzip.decompress(raw) == b"".join(found)
    assert sorted(seen) == list(range(40))


def plain_archive(path, bodies):
    with open(path, "wb") as f:
        for k, body in enumerate(bodies):
            f.write(gzip.compress(f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:{k}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"))


def test_archives_made_by_other_means(spark, tmp_path):
    paths = [tmp_path / "one two.warc.gz", tmp_path / "plain.warc"]
    plain_archive(paths[0], [b"a" * 200_000, b"", b"\x00\xff"])
    plain_archive(paths[1], [b"last"])
    uris = spark.createDataFrame([(p.as_uri(), 1) for p in paths] + [(None, 2)], "uri string, path int")
    got = warc.read_archives(uris, path_col="uri").collect()
    assert sorted((r["record_id"], bytes(r["payload"])) for r in got) == sorted([("<urn:x:0>", b"a" * 200_000), ("<urn:x:1>", b""), ("<urn:x:2>", b"\x00\xff"), ("<urn:x:0>", b"last")])


@pytest.mark.parametrize("harm", ["cut", "flip", "text"])
def test_harmed_archives_are_named(spark, tmp_path, harm):
    path = tmp_path / f"{harm}.warc.gz"
    plain_archive(path, [b"first", random.Random(1).randbytes(5000)])
    raw = bytearray(path.read_bytes())
    if harm == "cut":
        raw = raw[:-20]
    elif harm == "flip":
        raw[-3000] ^= 0xFF
    else:
        raw += b"no gzip at all"
    path.write_bytes(raw)
    with pytest.raises(Exception, match=f"{harm}.warc.gz, member at or after byte"):
        warc.read_archives(spark.createDataFrame([(path.as_uri(),)], "path string")).collect()


# ---- urls


def brute_limit(rows):
    """The bin edge with the least sum of error rates, the lowest of equals; rows are (mean, accepted)."""
    edge = lambda m: max(-urlfilter.OUTERMOST, min(urlfilter.OUTERMOST, m // urlfilter.BIN * urlfilter.BIN))
    good, bad = [edge(m) for m, ok in rows if ok], [edge(m) for m, ok in rows if not ok]
    if not good or not bad:
        return -2 * urlfilter.OUTERMOST
    edges = sorted(set(good + bad))
    limits = [-2 * urlfilter.OUTERMOST, *edges[1:], 2 * urlfilter.OUTERMOST]
    cost = lambda t: sum(x < t for x in good) / len(good) + 1 - sum(x < t for x in bad) / len(bad)
    return min(limits, key=lambda t: (cost(t), t))


@pytest.mark.parametrize("seed", range(4))
def test_threshold_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    # few different means, so that edges and costs tie
    rows = [(rng.randint(-3, 3) * urlfilter.BIN * 7 + rng.choice([0, 1]), 7, rng.random() < 0.5, rng.randint(1, 3)) for _ in range(12)]
    if seed == 3:
        rows = [(t, n, True, c) for t, n, _, c in rows]
    df = spark.createDataFrame(rows, "total long, n int, accepted boolean, copies int")
    assert urlfilter.threshold(df) == brute_limit([(t // n, ok) for t, n, ok, c in rows for _ in range(c)])


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(6)
    word = lambda letters, n: "".join(rng.choices(letters, k=n))
    urls = [f"http://{word('abcde', 5)}.com/{word('abc', 6)}" for _ in range(60)] + [f"http://{word('vwxyz', 5)}.net/es/{word('xyz9', 6)}" for _ in range(60)]
    urls += [f"http://{word(rng.choice(['abcde', 'vwxyz']), 5)}.org/{word(rng.choice(['abc', 'xyz9']), 6)}" for _ in range(60)]
    urls += [None, "none", "http://", urls[130], urls[130]]
    pages = spark.createDataFrame([(k % 150, u, "x") for k, u in enumerate(urls)], "page_id long, url string, g string")
    got = urlfilter.judge(pages).collect()
    assert len(got) == len(urls)
    rows = urlfilter.with_rule(pages, urlfilter.RULES, "url").withColumn("signs", urlfilter._signs(F.concat("host", "path"))).withColumn("h", F.xxhash64("signs")).collect()
    decided = [(r["host"] + r["path"], r["action"] == "allow", r["h"] % urlfilter.CALIBRATION == 0) for r in rows if r["action"]]
    texts = {r["host"] + r["path"] for r in rows}
    total = brute_scores([(t, ok) for t, ok, out in decided if not out], texts)
    mean = {t: total[t] / (len(t) + 1) for t in texts}
    limit = brute_limit([(math.floor(mean[t]), ok) for t, ok, out in decided if out])
    actions = {(r["host"], r["path"]): r["action"] for r in rows}
    for r in got:
        if r["rule"] is not None:
            assert r["verdict"] == actions[r["host"], r["path"]] and r["score"] is None
            continue
        assert abs(r["score"] - mean[r["host"] + r["path"]]) <= 5  # a unit per rounded logarithm
        if abs(mean[r["host"] + r["path"]] - limit) > 5:
            assert r["verdict"] == ("allow" if r["score"] >= limit else "block")


def test_a_mean_at_the_threshold_is_allowed(spark, monkeypatch):
    pages = spark.createDataFrame([(1, "http://q.org/z"), (2, "http://q.com/z"), (3, "http://q.net/es/z")], "page_id long, url string")
    score = next(r["score"] for r in urlfilter.judge(pages).collect() if r["page_id"] == 1)
    for limit, verdict in ((score, "allow"), (score + 1, "block")):
        monkeypatch.setattr(urlfilter, "threshold", lambda decided, limit=limit: limit)
        assert next(r["verdict"] for r in urlfilter.judge(pages).collect() if r["page_id"] == 1) == verdict


def test_urls_of_a_million_characters(spark):
    n = 1_000_000
    pages = spark.createDataFrame([(1, "http://long.org/" + "ab/" * (n // 3)), (2, "http://a.com/" + "x" * n), (3, "http://b.org/x")], "page_id long, url string")
    urlfilter.judge(pages.where("page_id = 3")).collect()
    began = time.time()
    got = urlfilter.judge(pages).select("page_id", F.length("path").alias("n"), "verdict").collect()
    assert {r["page_id"] for r in got} == {1, 2, 3} and time.time() - began < 60
