"""Long texts in pieces give what they give whole, in bounded memory; links of secrets against brute force."""

import random
import re
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from planwalk.llm import langid, secrets, shingles, wordhash


def texts_of(seed):
    rng = random.Random(seed)
    some = lambda n: "".join(rng.choices(["a", "B", "é", "ß ", " ", "word ", "\n", "😀", "x" * 50], k=n))
    return [some(rng.randint(0, 400)) for _ in range(30)] + [None, "", " ", "one", "two words", "é" * 900, " " * 900, "tail " * 300 + "end"]


@pytest.mark.parametrize("size", [1, 2, 5])
def test_sets_of_pieces(monkeypatch, size):
    data, offsets = wordhash.text_buffer(pa.array(texts_of(size), pa.string()))
    whole = [(h[c - n : c].tolist()) for _, _, h, counts in shingles.sets(data, offsets, size) for n, c in zip(counts, np.cumsum(counts), strict=True)]
    for segment, held in ((64, 1 << 20), (150, 5)):
        monkeypatch.setattr(wordhash, "SEGMENT_BYTES", segment)
        monkeypatch.setattr(shingles, "SEGMENT_SHINGLES", held)
        cut = [(h[c - n : c].tolist()) for _, _, h, counts in shingles.sets(data, offsets, size) for n, c in zip(counts, np.cumsum(counts), strict=True)]
        assert cut == whole


def test_grams_of_pieces(monkeypatch):
    data, offsets = wordhash.text_buffer(pa.array(texts_of(7), pa.string()))

    def tallies():
        out = np.zeros((len(offsets) - 1, len(langid.ORDERS), langid.BUCKETS), np.int64)
        for i, j, found in langid.grams(data, offsets):
            for k, (buckets, counts) in enumerate(found):
                np.add.at(out[:, k], (np.repeat(np.arange(i, j), counts), buckets), 1)
        return out

    whole = tallies()
    for segment in (64, 129):
        monkeypatch.setattr(wordhash, "SEGMENT_BYTES", segment)
        assert (tallies() == whole).all()


def test_languages_of_long_texts(spark, monkeypatch):
    docs = spark.createDataFrame([(k, t * 40, lang) for k in range(30) for t, lang in (("the house and the garden ", "en"), ("das Haus und der Garten ß ", "de"))], "doc_id long, text string, lang string")
    model = langid.train(docs)
    whole = [tuple(r) for r in langid.predict(docs, model).orderBy("doc_id", "lang").collect()]
    assert all(r[3] == r[2] for r in whole) and langid._some_letter(np.frombuffer(b"1" * 300 + "é".encode(), np.uint8))


MEMORY = """
import resource, numpy as np, pyarrow as pa
from planwalk.llm import langid, shingles, wordhash
text = ("lorem ipsum dolor sit amet %d consectetur " * 8).encode()
raw = b"".join(text.replace(b"%d", str(k).encode()) for k in range(100_000_000 // len(text)))
data, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(len(h) for _, _, h, _ in shingles.sets(data, offsets, 5))
m = sum(int(c.sum()) for _, _, found in langid.grams(data, offsets) for _, c in found)
print(n > 0, m > 2 * len(raw), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_a_text_of_100_megabytes_takes_bounded_memory():
    out = subprocess.run([sys.executable, "-c", MEMORY], capture_output=True, text=True, timeout=300, check=True).stdout.split()
    assert out[:2] == ["True", "True"] and int(out[2]) < 900


def brute_links(text, scope=secrets.SCOPE):
    """Spans that are reported: all parts by pattern, then each weak one by a look at all others."""
    parts = []
    for pattern in dict.fromkeys(k.pattern for k in secrets.KINDS):
        for m in re.finditer(pattern, text):
            for k in secrets.KINDS:
                if k.pattern == pattern and k.low <= len(m.group(k.group)) <= (k.high or 1 << 40):
                    parts.append((m.start(), secrets.KINDS.index(k), m.end(), k))
    held = []
    for p in parts:
        fits = [q for q in parts if q[3].role != p[3].role and abs(q[0] - p[0]) <= scope]
        fits = [q for q in fits if q[2] <= p[0] or p[2] <= q[0] or any(a[3].name == "endpoint" and a[0] <= b[0] and b[2] <= a[2] for a, b in ((p, q), (q, p)))]
        if p[3].base or fits:
            held.append(p)
    return ",".join(f"{k.name}:{a}:{b}" for a, _, b, k in sorted(held, key=lambda x: (x[0], x[1], x[2])))


def test_links_equal_brute_force(spark):
    rng = random.Random(1)
    bits = ["password: abc123@x.com ", "login=bob ", "token=abcdef ", "AKIAABCDEFGH ", "https://h.io/?token=abcdef ", "me@x.org ", "deadbeefdeadbeef00 ", "é ", "secret: s3cret/7 "]
    texts = ["".join(rng.choice(bits) + "." * rng.choice([0, 3, 90, 180, 400]) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    # starts exactly at the scope and one beyond it; a part that would be its own complement
    texts += ["login=bob" + " " * (gap - 9) + "token=abcdef" for gap in (secrets.SCOPE - 1, secrets.SCOPE, secrets.SCOPE + 1)] + ["password: abc123@x.com", "https://h.io/?token=abcdef", None, ""]
    texts += texts[:3]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["s"] for r in secrets.scan(rows).orderBy("doc_id").select(secrets.listed(F.col("spans")).alias("s")).collect()]
    assert got == [brute_links(t or "") for t in texts]
    assert "weak" not in got[texts.index("password: abc123@x.com")]
