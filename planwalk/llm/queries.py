"""The registered queries of this subpackage and their SQL; one module per operator holds the work."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planwalk.llm import bitpack, decontaminate, langid, lexical, linededup, mixing, neardup, orchard, packing, secrets, store, topk, urlfilter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_bit_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents' ids as bit-packed shards and digests what the reader finds in them."""
    out = store.scratch(spark, "ids")
    bitpack.write_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), out, end_id=1)
    return bitpack.read_shards(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences of 1024 tokens."""
    return packing.best_fit(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, room=1024)


@query
def op8_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all pages as WARC archives and returns what the sequential reader finds."""
    out = store.scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), out)
    return warc.read(spark, out, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


ORACLES["op8_warc_archives"] = """
SELECT page_id, n AS payload_bytes, d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to, true AS digest_ok
FROM (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d,
        max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages) t
"""


@query
def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports the words of all documents that occur in windows of benchmark items."""
    found = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    digest = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


ORACLES["op10_benchmark_decontamination"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
  b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM benchmark),
  bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS w, array_to_string(ws[q:q + least(10, len(ws)) - 1], ' ') AS g
    FROM (SELECT item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS q FROM b WHERE len(ws) > 0) t),
  sizes AS (SELECT DISTINCT w FROM bw),
  dw AS (SELECT doc_id, w, p, array_to_string(ws[p:p + w - 1], ' ') AS g
    FROM (SELECT doc_id, ws, w, unnest(range(1, len(ws) - w + 2)) AS p FROM d, sizes WHERE len(ws) >= w) t),
  hit AS (SELECT doc_id, p, dw.w, item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.w = bw.w),
  words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + w)) AS x FROM hit) t GROUP BY doc_id),
  items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids
    FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS i FROM hit) t GROUP BY doc_id)
SELECT d.doc_id, cast(len(ws) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words ON words.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id
"""


@query
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups all documents whose sets of 2-word shingles are at least 80 % alike."""
    return neardup.groups(table(spark, sf_dir, "documents"), size=2, percent=80)


@query
def op5_kd_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best other vectors for each vector whose id is divisible by 100."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10, steps=1024)


ORACLES["op5_kd_tree_top_k"] = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * cast(x AS double))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT q.vec_id AS query_id, c.vec_id, cast(list_inner_product(q.v, c.v) AS bigint) AS score
    FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, cast(rank AS integer) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) t WHERE rank <= 10
"""


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicts the language of all documents with a model that has not seen the held-out ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


@query
def op4_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops all documents' repeated and nearly repeated lines and digests what stays."""
    found = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLES["op4_line_edit_join"] = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
  l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM d),
  f AS (SELECT line, length(line) AS n, min(doc_id * 1000000 + pos) AS o FROM l WHERE length(line) >= 20 GROUP BY line),
  parts AS (SELECT line, n, o, n // 3 AS k, n - 2 * (n // 3) AS m FROM f),
  -- lines within two edits share one of three parts, up to a shift of two
  keys AS (SELECT line, n, o, 1 AS i, line[1:k] AS s, k FROM parts
    UNION ALL SELECT line, n, o, 2, line[k + 1:2 * k], k FROM parts
    UNION ALL SELECT line, n, o, 3, line[2 * k + 1:n], k FROM parts),
  cand AS (SELECT DISTINCT a.line AS x, b.line AS y, a.o AS ax, b.o AS ay
    FROM keys a JOIN f b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.line <> b.line
      AND CASE a.i WHEN 1 THEN b.line[1:a.k] = a.s WHEN 3 THEN b.line[b.n - length(a.s) + 1:b.n] = a.s
        ELSE b.line[a.k + 1:2 * a.k] = a.s OR b.line[a.k:2 * a.k - 1] = a.s OR b.line[a.k + 2:2 * a.k + 1] = a.s
          OR b.line[a.k - 1:2 * a.k - 2] = a.s OR b.line[a.k + 3:2 * a.k + 2] = a.s END),
  gone AS (SELECT DISTINCT y AS line FROM cand WHERE ax < ay AND levenshtein(x, y) <= 2
    UNION SELECT DISTINCT x FROM cand WHERE ay < ax AND levenshtein(x, y) <= 2),
  stays AS (SELECT l.doc_id, l.pos, l.line FROM l LEFT JOIN f ON l.line = f.line
    WHERE f.line IS NULL OR (f.o = l.doc_id * 1000000 + l.pos AND l.line NOT IN (SELECT line FROM gone))),
  texts AS (SELECT doc_id, count(*) AS n_kept, string_agg(line, chr(10) ORDER BY pos) AS t FROM stays GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(ls), 0) AS n_lines, coalesce(n_kept, 0) AS n_kept, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN texts ON texts.doc_id = d.doc_id
"""


@query
def op2_url_character_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judges all pages' urls by rules, and by the character models where no rule fits."""
    return urlfilter.judge(table(spark, sf_dir, "pages"))


@query
def op7_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finds secrets in all documents and links weak candidates to complementary parts."""
    found = secrets.scan(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secrets.listed(base), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def _secret_parts() -> str:
    """One SELECT per kind: offsets from the lengths of what the pattern's split leaves and of its matches."""
    quote = lambda s: s.replace("'", "''")
    one = """SELECT doc_id, {k} AS ord, '{name}' AS kind, '{role}' AS role, {base} AS base, stop - m AS start, stop FROM (
  SELECT doc_id, m, g, sum(p + coalesce(m, 0)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM (
    SELECT doc_id, unnest(range(0, len(ps))) AS i, unnest(list_transform(ps, lambda x: length(x))) AS p,
      unnest(list_transform(ms, lambda x: length(x))) AS m, unnest(list_transform(gs, lambda x: length(x))) AS g
    FROM (SELECT doc_id, regexp_split_to_array(t, '{pattern}') AS ps, regexp_extract_all(t, '{pattern}', 0) AS ms,
        regexp_extract_all(t, '{pattern}', {group}) AS gs FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) a) b) c) d
WHERE m IS NOT NULL AND g >= {low}{high}"""
    return "\nUNION ALL\n".join(
        one.format(k=k, name=x.name, role=x.role, base=str(x.base).lower(), pattern=quote(x.plain), group=x.group, low=x.low, high=f" AND g <= {x.high}" if x.high else "") for k, x in enumerate(secrets.KINDS)
    )


ORACLES["op7_linked_secrets"] = f"""
WITH parts AS ({_secret_parts()}),
  found AS (SELECT doc_id, ord, kind, start, stop, base FROM parts p WHERE base
      OR EXISTS (SELECT 1 FROM parts q WHERE q.doc_id = p.doc_id AND q.role <> p.role
        AND abs(q.start - p.start) <= {secrets.SCOPE} AND (q.stop <= p.start OR p.stop <= q.start
          OR (p.kind = 'endpoint' AND p.start <= q.start AND q.stop <= p.stop) OR (q.kind = 'endpoint' AND q.start <= p.start AND p.stop <= q.stop)))),
  listed AS (SELECT doc_id, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex,
      string_agg(CASE WHEN base THEN concat(kind, ':', start, ':', stop) END, ',' ORDER BY start, ord) AS b,
      string_agg(concat(kind, ':', start, ':', stop), ',' ORDER BY start, ord, stop) AS s FROM found GROUP BY doc_id)
SELECT d.doc_id, cast(coalesce(n_assign, 0) AS bigint) AS n_assign, cast(coalesce(n_access, 0) AS bigint) AS n_access,
  cast(coalesce(n_hex, 0) AS bigint) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(s, '') AS spans
FROM documents d LEFT JOIN listed ON listed.doc_id = d.doc_id
"""


@query
def op11_orchard_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors in 16 parts, with codebooks of 64 entries after two rounds."""
    return orchard.quantize(table(spark, sf_dir, "embeddings"), parts=16, entries=64, rounds=2, scale=256)


def _code_rounds() -> str:
    """The assignment of all parts and the next codebook, twice, and the last assignment."""
    assign = """, a{k} AS (SELECT vec_id, label, p.part, x, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS bigint) * 64 + e) AS m
    FROM p JOIN c{k} ON c{k}.part = p.part GROUP BY vec_id, label, p.part, x)"""
    refine = """, s{k} AS (SELECT part, e, list(v ORDER BY i) AS c FROM (SELECT part, m % 64 AS e, i, floor(sum(x[i]) / count(*)) AS v
      FROM a{k}, range(1, 65) r(i) WHERE i <= len(x) GROUP BY part, m % 64, i) t GROUP BY part, e),
  c{n} AS (SELECT c{k}.part, c{k}.e, coalesce(s{k}.c, c{k}.c) AS c FROM c{k} LEFT JOIN s{k} ON s{k}.part = c{k}.part AND s{k}.e = c{k}.e)"""
    return "".join((assign + refine).format(k=k, n=k + 1) for k in range(2)) + assign.format(k=2)


ORACLES["op11_orchard_codes"] = f"""
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * cast(x AS double))) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  p AS (SELECT vec_id, label, i AS part, v[i * (len(v) // 16) + 1:(i + 1) * (len(v) // 16)] AS x FROM v, range(16) r(i)),
  c0 AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS e, x AS c
    FROM p WHERE vec_id IN (SELECT vec_id FROM v ORDER BY vec_id LIMIT 64)){_code_rounds()},
  done AS (SELECT vec_id, label, string_agg(printf('%02x', m % 64), '' ORDER BY part) AS code, sum(m // 64) AS error FROM a2 GROUP BY vec_id, label),
  book AS (SELECT sha256(string_agg(s, ',' ORDER BY part, e)) AS h
    FROM (SELECT part, e, array_to_string(list_transform(c, lambda x: cast(cast(x AS bigint) AS varchar)), ',') AS s FROM c2) t)
SELECT vec_id, code, cast(error AS bigint) AS error, cast(sum(error) OVER (PARTITION BY label) AS bigint) AS label_error, h AS codebooks_sha256 FROM done, book
"""


@query
def op13_budgeted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents' sources to their targets."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query
def op12_length_strata_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best documents for each benchmark item."""
    return lexical.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


ORACLES["op12_length_strata_search"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
  b AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')) AS w FROM benchmark),
  q AS (SELECT item_id, w, count(*) AS c FROM b GROUP BY item_id, w),
  size AS (SELECT count(*) AS n_docs, sum(len(ws)) AS total FROM d WHERE len(ws) > 0),
  tf AS (SELECT doc_id, n, w, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS w FROM d) t
    WHERE w IN (SELECT w FROM q) GROUP BY doc_id, n, w),
  weight AS (SELECT w, floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1))) AS x FROM tf, size GROUP BY w),
  gain AS (SELECT doc_id, tf.w, cast(x AS bigint) * ((1000000000 * tf) // (1000 * tf + 12 * (75 + cast((25 * n * n_docs) // total AS bigint)))) AS g
    FROM tf JOIN weight ON weight.w = tf.w, size),
  s AS (SELECT item_id, doc_id, cast(sum(c * g) AS bigint) AS score FROM q JOIN gain ON gain.w = q.w GROUP BY item_id, doc_id)
SELECT item_id, cast(rank AS integer) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) t WHERE rank <= 20
"""
