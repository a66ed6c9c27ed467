"""Secret scan with DataFrame functions alone, and linking of the parts of a credential.

Base kinds are found by pattern and always reported.  Weak candidates (short secrets, short
access keys, logins, addresses) are reported only where a complementary part lies within the
same scope of SCOPE characters: a secret needs an identifier or an endpoint, an identifier
or an endpoint needs a secret.

Offsets come from what a pattern's split leaves between its matches: the lengths of pieces
and matches, summed up in order, are the code point offsets of the matches.  Kinds that
differ in length alone share a pattern and its scan.  No pattern recurses or tries a run of
signs anew from each of its places, so the work grows with the length of a text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planwalk.llm.store import ROW, fresh, row_key, written

SCOPE = 200


@dataclass(frozen=True)
class Kind:
    """A pattern; `hint` cheaply tells texts that may match, `group` is what must have `low` to `high` characters."""

    name: str
    role: str
    pattern: str
    hint: str
    group: int
    low: int
    high: int | None = None
    base: bool = False

    @property
    def plain(self) -> str:
        """The pattern with greedy in place of possessive repeats, for engines that never go back; both match the same."""
        return self.pattern.replace("}+", "}").replace("++", "+")

    def hinted(self, text: Column) -> Column:
        return text.rlike(self.hint) if self.hint[0] in "([" else F.contains(text, F.lit(self.hint))


#: The patterns of the scan, in the order in which equal starts are listed.
ASSIGNED = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
SECRET_WORDS = r"password|passwd|secret|token|api_?key"
LOGIN_WORDS = r"client_?id|account_?id|user_?name|login"
KINDS = (
    Kind("assign", "secret", rf"(?i)({SECRET_WORDS}){ASSIGNED}", rf"""(?i)(?:{SECRET_WORDS})["']?\x20*[:=]""", 2, 12, base=True),
    Kind("access", "holder", r"AKIA[A-Z0-9]+", "AKIA", 0, 18, base=True),
    Kind("hex", "secret", r"[0-9a-f]{16,}", r"[0-9a-f]{16}", 0, 16, base=True),
    Kind("weak", "secret", rf"(?i)({SECRET_WORDS}){ASSIGNED}", rf"""(?i)(?:{SECRET_WORDS})["']?\x20*[:=]""", 2, 6, 11),
    Kind("key_id", "holder", r"AKIA[A-Z0-9]+", "AKIA", 0, 8, 17),
    Kind("login", "holder", rf"(?i)({LOGIN_WORDS}){ASSIGNED}", rf"""(?i)(?:{LOGIN_WORDS})["']?\x20*[:=]""", 2, 3),
    Kind("address", "holder", r"[A-Za-z0-9._+-]{1,64}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", 0, 6),
    Kind("endpoint", "holder", r"""[A-Za-z][A-Za-z0-9+.-]{0,31}+://[^\x00-\x20"'<>]++""", "://", 0, 8),
)


def _places(text: Column, kind: Kind) -> Column:
    """Lengths of (piece before, match, group) of each match, and of the piece after the last; null where the hint does not hold."""
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    zipped = F.arrays_zip(F.split(text, kind.pattern).alias("p"), matches.alias("m"))
    group = lambda m: m if kind.group == 0 else F.regexp_extract(m, kind.pattern, kind.group)
    lengths = F.transform(zipped, lambda z: F.struct(F.length(z["p"]).alias("p"), F.length(z["m"]).alias("m"), F.length(group(z["m"])).alias("g")))
    return F.when(kind.hinted(text), lengths)


def _kind(scan: Column, size: Column) -> Column:
    """Of which kind a match of a scan is, by the length of its group; null for none."""
    patterns = list(dict.fromkeys(k.pattern for k in KINDS))
    found = F.lit(None)
    for ord_, k in enumerate(KINDS):
        fits = (scan == patterns.index(k.pattern)) & (size >= k.low) & (size <= (k.high or (1 << 31) - 1))
        here = F.struct(F.lit(ord_).alias("ord"), F.lit(k.name).alias("kind"), F.lit(k.role).alias("role"), F.lit(k.base).alias("base"))
        found = F.when(fits, here).otherwise(found)
    return found


def parts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(dk, dk2, ord, kind, role, base, start, stop) of every base span and weak candidate; leftmost non-overlapping per pattern, then told apart by length."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    scans = list({k.pattern: k for k in KINDS}.values())
    found = F.array(*(F.struct(F.lit(n).alias("scan"), _places(text, kind).alias("at")) for n, kind in enumerate(scans)))
    rows = docs.select(*row_key(id_col, text_col), F.explode(F.filter(found, lambda k: k["at"].isNotNull())).alias("k")).distinct()
    rows = rows.select(*ROW, "k.scan", F.posexplode("k.at").alias("i", "z"))
    so_far = Window.partitionBy(*ROW, "scan").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum(F.col("z.p").cast("long") + F.coalesce("z.m", F.lit(0))).over(so_far))
    rows = rows.where(F.col("z.m").isNotNull()).withColumn("of", _kind(F.col("scan"), F.col("z.g"))).where(F.col("of").isNotNull())
    return rows.select(*ROW, "of.*", (F.col("stop") - F.col("z.m")).alias("start"), "stop")


def link(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The parts to report: base spans, and weak candidates with a complementary part that starts at most `scope` characters away and shares no character with them; but a secret may stand inside an endpoint.

    An interval join: starts are dealt into buckets of `scope` characters, and a weak candidate
    looks for one complement in its own bucket and the two beside it.  A bucket holds no more
    parts than its characters allow, so the work grows with the number of parts.
    """
    bucket = F.floor(F.col("start") / scope)
    flipped = F.when(F.col("role") == "secret", "holder").otherwise("secret")
    others = found.select(*(F.col(c).alias(f"o_{c}") for c in ROW), bucket.alias("o_b"), flipped.alias("o_role"), *(F.col(c).alias(f"o_{c}") for c in ("kind", "start", "stop")))
    weak = found.where("not base").withColumn("b", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
    same = F.col("b") == F.col("o_b")
    for c in (*ROW, "role"):
        same &= F.col(c) == F.col(f"o_{c}")
    apart = "o_stop <= start OR stop <= o_start OR kind = 'endpoint' AND start <= o_start AND o_stop <= stop OR o_kind = 'endpoint' AND o_start <= start AND stop <= o_stop"
    linked = weak.join(others, same & (F.abs(F.col("start") - F.col("o_start")) <= scope) & F.expr(apart), "left_semi").select(found.columns).distinct()
    return found.where("base").unionByName(linked)


def scan(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col and spans, an array of (start, ord, stop, kind, base) in that order.

    A null text is an empty one; rows that repeat id and text get the same spans; a text may
    be of any length; an empty table gives no rows.
    """
    spans = link(written(parts(docs, id_col, text_col), "secret-parts"), scope).groupBy(*ROW).agg(F.array_sort(F.collect_list(F.struct("start", "ord", "stop", "kind", "base"))).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,ord:int,stop:bigint,kind:string,base:boolean>>")
    rows = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col)).join(spans, ROW, "left")
    return rows.select(F.col("id").alias(id_col), F.coalesce("spans", empty).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def redact(docs: DataFrame, mark: str = "[secret]", scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, with all columns whatever their names, and every reported span of text_col replaced by `mark`; overlapping spans become one."""
    k1, k2, runs_col = fresh(docs, "k1", "k2", "runs")
    found = link(written(parts(docs, id_col, text_col), "secret-parts"), scope)
    before = Window.partitionBy(*ROW).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("stop").over(before)
    order = Window.partitionBy(*ROW).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, 0)
    runs = found.withColumn("run", (reach.isNull() | (F.col("start") >= reach)).cast("int")).withColumn("run", F.sum("run").over(order))
    merged = runs.groupBy(*ROW, "run").agg(F.min("start").alias("low"), F.max("stop").alias("high")).groupBy(F.col("dk").alias(k1), F.col("dk2").alias(k2))
    merged = merged.agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias(runs_col))
    joined = docs.select("*", *(c.alias(k) for c, k in zip(row_key(id_col, text_col), (k1, k2), strict=True))).join(merged, [k1, k2], "left")
    text, spans, n = F.col(text_col), F.col(runs_col), F.size(runs_col)
    end = lambda i: F.when(i < 0, 0).otherwise(F.get(spans, i)["high"])
    kept = F.transform(spans, lambda r, i: F.concat(F.substring(text, (end(i - 1) + 1).cast("int"), (r["low"] - end(i - 1)).cast("int")), F.lit(mark)))
    last = F.substring(text, (end(n - 1) + 1).cast("int"), F.length(text))
    return joined.withColumn(text_col, F.when(spans.isNotNull(), F.concat(F.array_join(kept, ""), last)).otherwise(text)).select(*docs.columns)
