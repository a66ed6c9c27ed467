"""Hot groups, very long texts, clashing columns, repeated rows and hash collisions in the corpus operators."""

import collections
import hashlib
import math
import random
import time
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from planwalk.llm import bitpack, decontaminate, encoder, langid, linededup, neardup, packing, secrets, store, topk, warc, wordhash

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def thue_morse(n):
    """A word of 2 ** n letters a and b, and its complement: equal under every sum of odd powers modulo 2 ** 64."""
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


# ---- words and shingles


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_words_of_one_hash_keep_their_ids(path, monkeypatch):
    own = Tokenizer.from_file(path)
    texts = [f"w{k} x{k % 7} {'y' * (k % 90)}\nz{k}" for k in range(300)] + list(thue_morse(11))
    real = wordhash.hashes
    monkeypatch.setattr(wordhash, "hashes", lambda data, starts, ends: real(data, starts, ends) & np.uint64(15))
    enc = encoder.Encoder(path)
    for _ in range(2):
        ids, counts = enc.encode(*wordhash.text_buffer(pa.array(texts)))
        at = 0
        for t, n in zip(texts, counts.tolist(), strict=True):
            assert ids[at : at + n].tolist() == own.encode(t, add_special_tokens=False).ids
            at += n


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_long_texts_in_pieces(path, monkeypatch):
    monkeypatch.setattr(wordhash, "SEGMENT_BYTES", 500)
    monkeypatch.setattr(encoder, "PIECE_BYTES", 90)
    rng, own = random.Random(3), Tokenizer.from_file(path)
    texts = [" ".join(rng.choices(["ab", "ΑΣ", "c  d", "é", "it's", "x\n", "\u3000", "9.9", "w" * 40], k=rng.randint(0, 400))) for _ in range(20)] + ["x" * 3000]
    ids, counts = encoder.Encoder(path).encode(*wordhash.text_buffer(pa.array(texts)))
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == own.encode(t, add_special_tokens=False).ids
        at += n


def test_structured_words_in_queries(spark):
    a, b = thue_morse(11)
    docs = docs_of(spark, [a, b, f"{a} z", f"{b} z"])
    out = store.scratch(spark, "ids")
    bitpack.write_shards(docs, WORD, out, end_id=1)
    for path, rows in ((WORD, bitpack.read_shards(spark, out).select("doc_id", F.crc32("ids").alias("c"))), (BYTE, packing.best_fit(docs, BYTE, 2, 1 << 20).select("doc_id", F.col("ids_crc32").alias("c")))):
        own = Tokenizer.from_file(path)
        end = 1 if path == WORD else 2
        wanted = {r["doc_id"]: zlib.crc32(np.array([*own.encode(r["text"], add_special_tokens=False).ids, end], "<u4").tobytes()) for r in docs.collect()}
        assert {r["doc_id"]: r["c"] for r in rows.collect()} == wanted
    assert {r["component_id"] for r in neardup.groups(docs, size=2).collect()} == {0, 1, 2, 3}


def test_repeated_and_null_ids(spark):
    rows = [(None, "one two three"), (None, "one two three"), (5, "x"), (5, "x"), (5, "y"), (None, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = store.scratch(spark, "ids")
    bitpack.write_shards(docs, WORD, out, end_id=1)
    own = Tokenizer.from_file(WORD)
    size = lambda t: len(own.encode(t or "", add_special_tokens=False).ids) + 1
    got = bitpack.read_shards(spark, out).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in got) == sorted((str(i), size(t)) for i, t in rows)
    packed = packing.best_fit(docs, BYTE, 2, 16).collect()
    assert len(packed) == len(rows) and len({(r["sequence_id"], r["offset"]) for r in packed}) == len(rows)
    groups = neardup.groups(docs, size=2).collect()
    assert len(groups) == len(rows) and {r["component_id"] for r in groups if r["doc_id"] is None} == {None}


# ---- lines


def edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def kept_lines(texts, edits, least):
    first, seen = {}, []
    for d, t in enumerate(texts):
        for p, s in enumerate(t.split("\n")):
            if len(s) >= least and s not in first:
                first[s] = (d, p)
                seen.append(s)
    gone = {b for i, b in enumerate(seen) for a in seen[:i] if abs(len(a) - len(b)) <= edits and edit(a, b) <= edits}
    return ["\n".join(s for p, s in enumerate(t.split("\n")) if len(s) < least or (first[s] == (d, p) and s not in gone)) for d, t in enumerate(texts)], gone


@pytest.mark.parametrize("edits, common, masks", [(1, 128, 8), (1, 1, 0), (2, 128, 8), (2, 1, 8), (2, 1, 0), (3, 1, 8)])
def test_common_segments_equal_brute_force(spark, monkeypatch, edits, common, masks):
    monkeypatch.setattr(linededup, "COMMON", common)
    monkeypatch.setattr(linededup, "LINES_A_MASK", masks)
    monkeypatch.setattr(linededup, "BLOCK", 8)
    monkeypatch.setattr(linededup, "HEAVY_KEYS", 40)
    rng = random.Random(edits)
    bases = ["".join(rng.choices("abcé ", k=rng.randint(20, 46))) for _ in range(8)]
    texts = []
    for k in range(110):
        s = list(rng.choice(bases))
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(s))
            s[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
        texts.append("".join(s) + ("\nshort" if k % 9 == 0 else ""))
    wanted, gone = kept_lines(texts, edits, 20)
    assert len(gone) > 10
    got = linededup.dedup_lines(docs_of(spark, texts).repartition(3), edits).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == wanted


def split_distance(a, b):
    """Edit distance of two texts whose line ends stand on each other."""
    (a1, a2), (b1, b2) = a.split("\n"), b.split("\n")
    return edit(a1, b1) + edit(a2, b2)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_masks_equal_brute_force(spark, edits):
    """Short texts of two letters with a mark, ties of texts, the empty one; lines that are not open get no verdict."""
    rng = random.Random(edits)
    texts = ["".join(rng.choices("ab", k=rng.randint(0, 4))) + "\n" + "".join(rng.choices("abé", k=rng.randint(0, 4))) for _ in range(120)] + ["\n", "\n"]
    rows = [(k % 2, t, k, k % 5 != 0) for k, t in enumerate(texts)]
    wanted = {k for g, t, k, is_open in rows if is_open and any(h == g and j < k and split_distance(t, u) <= edits for h, u, j, _ in rows)}
    got = [r[0] for r in linededup._gone_by_masks(spark.createDataFrame(rows, "group long, text string, ord long, open boolean"), edits).collect()]
    assert set(got) == wanted and len(wanted) > 20


def test_numbered_lines_equal_brute_force(spark, monkeypatch):
    """Numbers of several lengths in one place, in two places, and another line under the same key, each in groups beyond a block."""
    monkeypatch.setattr(linededup, "COMMON", 8)
    monkeypatch.setattr(linededup, "BLOCK", 40)
    monkeypatch.setattr(linededup, "LINES_A_MASK", 0.5)
    made = []
    masks = linededup._gone_by_masks
    monkeypatch.setattr(linededup, "_gone_by_masks", lambda rows, edits: made.append(rows.count()) or masks(rows, edits))
    rng = random.Random(8)
    texts = [f"entry number {rng.randrange(10 ** rng.randint(3, 6))} of the long register" for _ in range(150)]
    texts += [f"page {rng.randrange(1000)} of the catalogue, sheet {rng.randrange(1000)}" for _ in range(120)]
    texts += ["entry number nought of the long registry", "entry number of the long register"]
    rng.shuffle(texts)
    wanted, gone = kept_lines(texts, 2, 20)
    got = linededup.dedup_lines(docs_of(spark, texts)).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == wanted and len(gone) > 20 and sum(made) > 150


def test_many_numbered_lines(spark):
    """40 000 lines that differ in one number: work linear in them, where all pairs would be 800 million."""
    docs = spark.range(40_000).select(F.col("id").alias("doc_id"), F.format_string("Entry number %06d of the long printed register", F.col("id") * 7919 % 1000003).alias("text"))
    began = time.time()
    assert linededup.dedup_lines(docs).where("n_kept = 1").count() == 679
    assert time.time() - began < 240


def test_one_segment_in_many_lines(spark):
    """20 000 lines that share a third; one in ten repeats another one but for a letter."""
    rng = random.Random(2)
    head, texts = "all of these lines begin with these same words, ", []
    for k in range(20_000):
        if k % 10 == 9:
            texts.append(texts[k - 5][:-1] + "#")
        else:
            texts.append(head + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=70)))
    began = time.time()
    got = linededup.dedup_lines(docs_of(spark, texts)).where("n_kept = 0").count()
    assert got == 2000 and time.time() - began < 300


def test_very_long_lines_and_texts(spark):
    line = "".join(random.Random(1).choices("abcdef ", k=300_000))
    many = "\n".join(f"line number {k * 7919 % 1000003} of a very long text {'abcdefghij'[k % 10] * 9}" for k in range(3000))
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs_of(spark, [line, line + "x", line + "xyzw", many, many])).collect()}
    assert [got[k]["n_kept"] for k in range(3)] == [1, 0, 1] and got[4]["n_kept"] == 0 and got[3]["n_lines"] == 3000


def test_line_dedup_of_clashing_columns(spark):
    line = "a line of more than twenty characters"
    docs = docs_of(spark, [line, line, None, "x", line]).select("*", *(F.concat(F.lit(f"{c} "), "doc_id").alias(c) for c in ("dk", "_dk", "_text", "_k1", "k1", "id", "pos", "places")))
    got = linededup.apply(docs.unionAll(docs)).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == [0, 0, 2, 2, 3, 3]
    assert all(r[c] == f"{c} {r['doc_id']}" for r in got for c in ("dk", "_dk", "_text", "_k1", "k1", "id", "pos", "places"))


# ---- secrets


def test_secrets_of_long_runs(spark):
    n = 1_000_000
    texts = ["a@b" + ".c" * n, "x@y.z " + "n" * n, "n" * n + "://x", "password" + " " * n, "f" * n, "AKIA" + "Z" * n + " token: abcdef", "a@" * (n // 2)]
    began = time.time()
    got = [r["spans"] for r in secrets.scan(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert time.time() - began < 120
    assert [(s["kind"], s["start"], s["stop"]) for s in got[4]] == [("hex", 0, n)]
    assert [(s["kind"], s["start"], s["stop"]) for s in got[5]] == [("access", 0, n + 4)]


def test_redact_of_clashing_columns(spark):
    docs = docs_of(spark, ["AKIAABCDEFGH near token: abcdef, é 0123456789abcdef0", None, "", "x"]).select("*", *(F.lit(c).alias(c) for c in ("dk", "dk2", "_runs", "_k1", "spans", "id")))
    got = secrets.redact(docs.unionAll(docs), "#").orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["# near #, é #"] * 2 + [None] * 2 + [""] * 2 + ["x"] * 2
    assert all(r[c] == c for r in got for c in ("dk", "dk2", "_runs", "_k1", "spans", "id"))
    assert secrets.scan(docs.where("false")).count() == 0 and secrets.redact(docs.where("false")).count() == 0


# ---- decontamination


def brute_hits(w, items, window=10):
    hit, found = set(), set()
    for k, own in items:
        n = min(window, len(own))
        windows = {tuple(own[q : q + n]) for q in range(len(own) - n + 1)} if own else set()
        for p in range(len(w) - n + 1) if own else ():
            if tuple(w[p : p + n]) in windows:
                hit |= set(range(p, p + n))
                found.add(str(k))
    return len(hit), sorted(found)


def test_pieces_of_long_items(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "PIECE_WORDS", 7)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 60)
    rng = random.Random(4)
    item = lambda n, k: rng.choices([f"w{i}" for i in range(k)], k=n)
    items = [(k, item(n, s)) for k, (n, s) in enumerate([(80, 9), (25, 2), (10, 9), (4, 9), (60, 1), (17, 40)])]
    texts = [item(rng.randint(0, 50), rng.choice([1, 2, 9])) for _ in range(30)] + [own[3:30] + ["x"] + own[40:52] for _, own in items]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in items] * 2, "item_id long, text string")
    for r in decontaminate.report(docs_of(spark, [" ".join(w) for w in texts]), bench).collect():
        assert (r["n_hit"], r["items"]) == brute_hits(texts[r["doc_id"]], items)


def test_item_of_many_words(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(40_000)}" for _ in range(100_000)]
    docs = docs_of(spark, [" ".join(words[500:560]), "none of it " * 50, "the " * 200_000, " ".join(words)])
    bench = spark.createDataFrame([(1, " ".join(words)), (2, "the " * 50_000)], "item_id long, text string")
    got = {r["doc_id"]: (r["n_hit"], r["items"]) for r in decontaminate.report(docs, bench).collect()}
    assert got == {0: (60, ["1"]), 1: (0, []), 2: (200_000, ["2"]), 3: (100_000, ["1"])}


def test_decontamination_of_clashing_columns(spark):
    passage = "one two three four five six seven eight nine ten"
    docs = docs_of(spark, [f"Keep this, {passage}; and this.", "nothing here", None]).select("*", *(F.lit(c).alias(c) for c in ("_s", "_d", "_k", "doc", "text_key", "item_id")))
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    got = decontaminate.cut_spans(docs.unionAll(docs), bench).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == ["Keep this; and this."] * 2 + ["nothing here"] * 2 + [None] * 2
    assert all(r[c] == c for r in got for c in ("_s", "_d", "_k", "doc", "text_key", "item_id"))
    assert [r["doc_id"] for r in decontaminate.drop_documents(docs, bench).orderBy("doc_id").collect()] == [1, 2]
    assert len(decontaminate.report(docs.unionAll(docs), bench).collect()) == 6


# ---- top k


def brute_top(rows, k, steps=1024):
    """query_id to [(vec_id, score)], in whole numbers of any size."""
    whole = [(i, [math.floor(Fraction(x) * steps) for x in v]) for i, v in rows]
    out = {}
    for q, v in whole:
        if q % 100 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for c, w in whole if c != q and len(w) == len(v))
            out[q] = [(c, -s) for s, c in scores[:k]]
    return out


@pytest.mark.parametrize("shard, part", [(16_384, 65_536), (20, 2)])
def test_top_k_over_shards_and_sizes(spark, monkeypatch, shard, part):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "PART_QUERIES", part)
    rng = np.random.default_rng(7)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.normal(size=(160, 5)).round(1))] + [(k, v.tolist()) for k, v in zip(range(200, 260), rng.normal(size=(60, 5)) * 1e5, strict=True)]
    rows += [(300, [70000.0] * 5), (301, [1e6, -1e6, 1e6, 0.5, 0.0]), (302, [2.0**22, 1.0, -1.0, 0.0, 1.0]), (400, [1.0, 0.0]), (401, [70000.0, 0.0]), (402, [2.0, 0.0])]
    rows += [(k, [0.5] * 5) for k in range(500, 530)]  # ties at the last rank, in several shards
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(c) for c in ("_q", "id", "v", "width")})
    got = {}
    for r in topk.top_k(df.repartition(5), F.col("vec_id") % 100 == 0, k=6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == brute_top(rows, 6)


def test_scores_beyond_a_long(spark):
    df = spark.createDataFrame([(0, [1e300]), (1, [1e300]), (2, [-1e300]), (3, [1.0])], "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, topk.HIGHEST), (3, topk.HIGHEST), (2, -topk.HIGHEST - 1)]


# ---- language


def test_language_equals_plain_naive_bayes(spark):
    rows = [("the cat and the dog", "en"), ("and then the end", "en"), ("der hund und die katze", "de"), ("le chat et le chien", "fr"), ("x", "aa"), (None, "de"), ("y", None)]
    asked = ["the dog", "die katze", "é 漢字 chat", "x", "  the\n", "9 !", "", None]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    buckets = lambda t: [b for _, _, found in langid.grams(*wordhash.text_buffer(pa.array([t]))) for part, _ in found for b in part.tolist()]
    assert len(buckets("ab")) == 4 + 3 + 2  # n-grams of line feed, a, b, line feed
    counts = {x: collections.Counter() for x in ("aa", "de", "en", "fr")}
    for t, x in rows:
        if t is not None and x is not None:
            counts[x].update(buckets(t))
    n = {"aa": 1, "de": 1, "en": 2, "fr": 1}
    for r in langid.predict(spark.createDataFrame([(t,) for t in asked], "text string").withColumn("score", F.lit("clash")), model).collect():
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        log = {x: math.log(n[x] / 5) + sum(math.log((counts[x][b] + langid.SMOOTHING) / (sum(counts[x].values()) + langid.SMOOTHING * langid.BUCKETS)) for b in buckets(r["text"])) for x in counts}
        best = max(log, key=log.get)
        assert r["lang_pred"] == best and abs(r["score"] - 1 / sum(math.exp(v - log[best]) for v in log.values())) < 1e-9


def test_many_and_long_languages(spark):
    rows = [(f"w{k} text", f"x{k:03d}") for k in range(300)] + [("the end " * 200_000, "en")] * 2
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = langid.train(docs)
    assert len(model.languages) == 256 and "en" in model.languages and "x254" in model.languages and "x255" not in model.languages
    got = langid.predict(docs.unionAll(docs), model).collect()
    assert len(got) == 604 and [r["lang_pred"] for r in got if r["lang"] == "en"] == ["en"] * 4
    assert langid.train(docs.where("false")).languages == ()


# ---- archives


def member(fields, block):
    raw = "WARC/1.0\r\n" + "".join(f"{f}\r\n" for f in fields) + f"content-LENGTH:{len(block)}\r\n\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(raw.encode() + block + b"\r\n\r\n") + gz.flush()


def test_archives_of_other_writers():
    sha1 = hashlib.sha1(b"body").hexdigest()
    http = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nX: y\r\n\r\nbody"
    records = [
        member(["WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:00000000-0000-0000-0000-000000000001>"], b"software: x\r\n"),
        member(["warc-type:request", "Content-Type: application/http; msgtype=request"], b"GET / HTTP/1.1\r\nHost: a\r\n\r\n"),
        member(["WARC-Type: response", "Content-Type: application/http;", " msgtype=response", "WARC-Target-URI: http://x/a%20b?c=%0A", f"WARC-Payload-Digest: SHA1:{sha1}"], http),
        member(["WARC-Type: metadata", "WARC-Block-Digest: sha-256:" + hashlib.sha256(b"m").hexdigest()], b"m"),
        member(["WARC-Type: resource", "Content-Type: text/plain", "WARC-Block-Digest: md5:" + hashlib.md5(b"other").hexdigest()], b"body"),
        member(["WARC-Type: revisit", "WARC-Refers-To: <urn:uuid:x>", "WARC-Payload-Digest: strange:1"], b""),
    ]
    got = [warc.parse(raw) for _, raw in warc.members(pa.BufferReader(b"".join(records)))]
    assert [r["record_type"] for r in got] == ["warcinfo", "request", "response", "metadata", "resource", "revisit"]
    assert [r["digest_ok"] for r in got] == [True, True, True, True, False, True] and {r["page_id"] for r in got} == {None}
    assert got[0]["record_id"] == "<urn:uuid:00000000-0000-0000-0000-000000000001>" and got[2]["url"] == "http://x/a%20b?c=%0A"
    assert (got[2]["payload"], got[2]["payload_digest"], got[2]["payload_bytes"]) == (b"body", sha1, 4) and got[5]["payload"] is None


@pytest.mark.parametrize("url", ["http://x/a%20b", "http://a/%41\r\nx", " x ", "", "é%0A"])
def test_uris_as_they_are(url):
    ((_, raw),) = warc.members(pa.BufferReader(warc.record(1, url, b"p")))
    assert warc.parse(raw)["url"] == url
    if url == url.strip() and "\n" not in url:
        assert f"WARC-Target-URI: {url}\r\n".encode() in raw


def test_distances_are_left_to_alike_lines(spark, monkeypatch):
    """Pairs whose counts of digits differ by more than two edits can do are out before the distance is asked for."""
    monkeypatch.setattr(linededup, "banded_distance", lambda a, b, edits: F.lit(0))
    lines = [f"the quick brown parcel number {k * 6} leaves the yard" for k in "123"]
    lines.append("the quick brown parcel number 333338 leaves the yard")
    found = linededup.dedup_lines(docs_of(spark, lines)).collect()
    assert sorted((r["doc_id"], r["n_kept"]) for r in found) == [(0, 1), (1, 1), (2, 1), (3, 0)]
