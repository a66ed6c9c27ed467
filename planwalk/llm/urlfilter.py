"""URL filter with DataFrame functions alone: host rules, and a character model for the rest.

URLs that a rule decides train two Markov models over characters, one of the accepted and
one of the rejected.  A character is predicted from the longest context of up to ORDER
characters that training has seen, smoothed towards the next shorter one; the score of a
URL is the mean difference of both log-likelihoods in integer millionths, so sums do not
depend on their order.  The threshold is calibrated on decided URLs left out of training.

The alphabet has fewer than 32 signs, so the model's tables have less than 32 ** (ORDER + 1)
rows however many URLs there are, and broadcasting them is safe.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwalk.llm.store import fresh, written

ORDER = 3
#: Weight of the next shorter context, in observations.
SHRINK = 2.0
UNIT = 1_000_000
#: Every CALIBRATION-th decided URL, by hash, sets the threshold instead of training.
CALIBRATION = 5
#: Width and outermost value of a calibration bin, in millionths.
BIN = 10_000
OUTERMOST = 5 * UNIT

#: Letters stand for themselves; digits, vowelless rest and others share signs.
SIGNS = "abcdefghijklmnopqrstuvwxyz./-"
DIGIT, OTHER, START, END = "0", "?", "^", "$"


@dataclass(frozen=True)
class Rule:
    """A host suffix and a path prefix with an action; text is host and path as one."""

    text: str
    action: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


#: The rules of the registered query.
RULES = (Rule("com/", "allow"), Rule("example.com/en/", "block"), Rule("www.example.com/en/", "allow"), Rule("net/es/", "block"), Rule("net/fr/", "block"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def with_rule(pages: DataFrame, rules: tuple[Rule, ...], url_col: str) -> DataFrame:
    """Adds host, path, rule (the longest that fits, else null) and action."""
    host, path = host_and_path(F.col(url_col))
    out = pages.withColumn("host", F.coalesce(host, F.lit(""))).withColumn("path", F.coalesce(path, F.lit("")))
    rule = action = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        rule, action = F.when(fits, r.text).otherwise(rule), F.when(fits, r.action).otherwise(action)
    return out.withColumn("rule", rule).withColumn("action", action)


def _signs(text: Column) -> Column:
    """The text in the model's alphabet, with ORDER start signs and one end sign."""
    low = F.lower(text)
    known = F.regexp_replace(F.regexp_replace(low, "[0-9]", DIGIT), f"[^a-z./0-]", r"\?")
    return F.concat(F.lit(START * ORDER), known, F.lit(END))


def _last_grams() -> Column:
    """All runs of ORDER + 1 signs, one for each predicted sign, in one pass over the text."""
    return F.regexp_extract_all("signs", F.lit(f"(?=(.{{{ORDER + 1}}}))"), F.lit(1))


def train(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(gram, score) and (context, escape) from rows with signs and accepted.

    score is ln(p / q) of a gram's last sign after the signs before it, p of the accepted and
    q of the rejected model; escape is what a sign that never followed a known context adds
    to its score after the next shorter one.
    """
    # neither these rows nor those of score() carry the text, so work and memory are linear in it
    last = decided.select("accepted", F.explode(_last_grams()).alias("g"))
    grams = last.select("accepted", F.explode(F.array(*(F.expr(f"right(g, {k + 1})") for k in range(ORDER + 1)))).alias("gram"))
    counts = grams.groupBy("gram").agg(F.count_if("accepted").alias("a"), F.count_if(~F.col("accepted")).alias("b"))
    counts = written(counts.withColumn("k", F.length("gram") - 1), "gram-counts")
    alphabet = len(SIGNS) + 4
    total = counts.where("k = 0").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("na"), F.coalesce(F.sum("b"), F.lit(0)).alias("nb"))
    p = {x: (F.col(x) + SHRINK / alphabet) / (F.col(f"n{x}") + SHRINK) for x in "ab"}
    # one row of totals meets at most `alphabet` rows of single signs
    level = counts.where("k = 0").crossJoin(F.broadcast(total)).select("gram", p["a"].alias("pa"), p["b"].alias("pb"))
    levels, escapes = [level], []
    for k in range(1, ORDER + 1):
        own = counts.where(F.col("k") == k).withColumn("context", F.expr(f"left(gram, {k})"))
        seen = own.groupBy("context").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
        shorter = level.select(F.col("gram").alias("tail"), F.col("pa").alias("qa"), F.col("pb").alias("qb"))
        own = own.join(seen, "context").withColumn("tail", F.expr(f"right(gram, {k})")).join(shorter, "tail")
        q = {x: (F.col(x) + SHRINK * F.col(f"q{x}")) / (F.col(f"n{x}") + SHRINK) for x in "ab"}
        level = own.select("gram", q["a"].alias("pa"), q["b"].alias("pb"))
        levels.append(level)
        escapes.append(seen.select("context", _unit(F.log((F.col("nb") + SHRINK) / (F.col("na") + SHRINK))).alias("escape")))
    score = levels[0]
    for x in levels[1:]:
        score = score.unionByName(x)
    escape = escapes[0]
    for x in escapes[1:]:
        escape = escape.unionByName(x)
    return written(score.select("gram", _unit(F.log(F.col("pa") / F.col("pb"))).alias("score")), "grams"), written(escape, "escapes")


def _unit(x: Column) -> Column:
    return F.round(x * UNIT).cast("long")


def score(rows: DataFrame, grams: DataFrame, escapes: DataFrame) -> DataFrame:
    """rows (with signs) with total and n: the summed score and the number of predicted signs; equal rows are kept apart by `copies`."""
    d, e = fresh(rows, "d", "e")
    once = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).cast("int").alias("copies")).withColumns({d: F.xxhash64("signs"), e: F.xxhash64(F.lit(5), "signs")})
    at = once.select(d, e, F.explode(_last_grams()).alias("g"))
    for k in range(ORDER + 1):
        at = at.join(F.broadcast(grams.select(F.col("gram").alias(f"g{k}"), F.col("score").alias(f"s{k}"))), F.expr(f"right(g, {k + 1}) = g{k}"), "left")
        if k:
            at = at.join(F.broadcast(escapes.select(F.col("context").alias(f"c{k}"), F.col("escape").alias(f"e{k}"))), F.expr(f"substring(g, {ORDER + 1 - k}, {k}) = c{k}"), "left")
    value = F.coalesce("s0", F.lit(0))
    for k in range(1, ORDER + 1):
        value = F.coalesce(F.col(f"s{k}"), F.coalesce(f"e{k}", F.lit(0)) + value)
    found = at.groupBy(d, e).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("_n"))
    # different rows may have the same signs: each of them added its grams to the sum
    own = F.length("signs") - ORDER
    joined = once.join(found, [d, e]).withColumn("n", own)
    return joined.withColumn("total", F.expr("total div (_n div n)")).select(*rows.columns, "total", "n", "copies")


def threshold(decided: DataFrame) -> int:
    """The bin edge of mean scores with the least sum of both error rates on scored, decided rows; accepts all if one kind is missing."""
    mean = F.greatest(F.lit(-OUTERMOST), F.least(F.lit(OUTERMOST), F.floor(F.col("total") / F.col("n") / BIN) * BIN)).cast("long")
    rows = decided.groupBy(mean.alias("edge")).agg(F.sum(F.when(F.col("accepted"), F.col("copies")).otherwise(0)).alias("a"), F.sum(F.when(~F.col("accepted"), F.col("copies")).otherwise(0)).alias("b"))
    bins = sorted((r["edge"], r["a"], r["b"]) for r in rows.collect())  # at most 2 * OUTERMOST / BIN + 1
    n_a, n_b = sum(x[1] for x in bins), sum(x[2] for x in bins)
    if not n_a or not n_b:
        return -2 * OUTERMOST
    best, lost, caught = (1.0, -2 * OUTERMOST), 0, 0
    for k, (_, a, b) in enumerate(bins):
        lost, caught = lost + a, caught + b
        upper = bins[k + 1][0] if k + 1 < len(bins) else 2 * OUTERMOST
        best = min(best, (lost / n_a + 1 - caught / n_b, upper))
    return best[1]


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: id_col, host, path, rule, verdict, score (mean, in millionths; null where a rule decides).

    A null url, or one without `://`, has neither host nor path and is scored as an empty
    text.  Repeated rows each get their row; urls may be of any length, the work grows in
    proportion.  A mean that equals the threshold is allowed.  Where no URL is accepted, or none rejected, by
    a rule, the method accepts all.
    """
    rows = with_rule(pages.select(id_col, url_col), rules, url_col).select(id_col, "host", "path", "rule", "action")
    signs = _signs(F.concat("host", "path")).alias("signs")
    decided = rows.where("action is not null").select(signs, (F.col("action") == "allow").alias("accepted"))
    kept_out = F.pmod(F.xxhash64("signs"), F.lit(CALIBRATION)) == 0
    grams, escapes = train(decided.where(~kept_out))
    limit = threshold(score(decided.where(kept_out), grams, escapes))
    open_rows = score(rows.where("action is null").select(id_col, "host", "path", signs), grams, escapes)
    mean = F.floor(F.col("total") / F.col("n")).cast("long")
    verdict = F.when(mean >= limit, "allow").otherwise("block")
    by_model = open_rows.select(id_col, "host", "path", F.lit(None).cast("string").alias("rule"), verdict.alias("verdict"), mean.alias("score"), F.explode(F.expr("sequence(1, copies)")))
    by_rule = rows.where("action is not null").select(id_col, "host", "path", "rule", F.col("action").alias("verdict"), F.lit(None).cast("long").alias("score"))
    return by_rule.unionByName(by_model.drop("col"))
