"""Line deduplication with DataFrame functions alone: a segment-partition edit join over distinct lines.

A line of at least `min_chars` characters stays only where its text occurs first, and only
if no other line within `edits` edits has its first occurrence before that; order is by
document id, then row key, then line number.  Shorter lines always stay.

The join: lines are put into classes of SPAN lengths; a line also belongs to the next class
if one that is up to `edits` characters longer does.  In a class, `edits + 1` segments of one
size are looked at: those of the first half count from the start of a line, the others from
its end.  Of two lines within `edits` edits, at least one segment i of the one stands in the
other, moved by at most min(i, edits - i) characters.  So a line posts its own segments and
probes for them at the few moved places, under a hash of (class, segment number, segment).
A sketch of letter counts, which one edit changes by two at most, and the length are
compared inside the join.  What is left is verified by a banded edit distance.

A key that more than COMMON lines share does not list their pairs.  All its lines are compared
with the first of them, which settles most of a group of variants in one round.  Lines that
are still open meet under their key again, now in semi-joins: a line leaves them once, if any
earlier line is near.  Of the lines of a key beyond BLOCK, only what is left of them without
the segment they share is looked at, and of that only what stands between the start and the
end that all of them have in common.  Where this is short for so many lines (numbered lists),
each line posts its masks: all texts that come of it by few deletions and by few signs put
out of sight.  Lines are near if and only if they share a mask at few enough edits, so the
first line of each mask settles the later ones, and no pair is listed.  All others meet by
segments of the rest, and keys that are common even then post masks or are dealt into blocks.
Keys that hold more than one in HEAVY_KEYS of all rows are fewer than HEAVY_KEYS, so they are
broadcast and their rows are never dealt by key.

Texts leave the scan only for documents that have a line to verify or to lose.  A bitmap of
fixed size tells the others; a document that it takes for one of them costs time alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planwalk.llm.store import ROW, fresh, in_sieve, row_key, sieve, written

MIN_CHARS = 20
EDITS = 2
#: Lengths in a class.
SPAN = 8
#: Rows of a key whose pairs are listed, bound of the number of keys that are broadcast, and rows of a key in a block.
COMMON = 128
HEAVY_KEYS = 1 << 17
BLOCK = 4096
#: Longest part between common start and end of which masks are made; lines for each mask of one beyond which they are.
MASKED = 64
LINES_A_MASK = 8
#: Letters counted in the sketch, four bits each; the next four bits hold the length, the next eight the slot.
SKETCH_LETTERS = "etanos"
#: Signs counted in a second sketch of lines that meet under common keys.
MORE_SIGNS = "0123456789cdhilr"
LENGTH_AT = 4 * len(SKETCH_LETTERS)
SLOT_AT = LENGTH_AT + 4


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(dk, dk2, id, text) of every row; rows that repeat id and text have one key."""
    return docs.select(*row_key(id_col, text_col), F.col(id_col).alias("id"), F.col(text_col).alias("text"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _sketch(line: Column, signs: str = SKETCH_LETTERS) -> Column:
    def part(k: int, letter: str) -> Column:
        n = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(letter), F.lit("")))
        return F.shiftleft(F.pmod(n, F.lit(16)).cast("long"), 4 * k)

    return reduce(lambda a, b: a.bitwiseOR(b), [part(k, c) for k, c in enumerate(signs)])


def _marks(line: Column) -> Column:
    return _sketch(line) + F.shiftleft(F.pmod(F.length(line), F.lit(16)).cast("long"), LENGTH_AT)


def _alike(edits: int, *more: str) -> Column:
    """Whether lengths and sketches of two rows a and b allow so few edits; more: names of further sketches."""

    def part(name: str, at: int) -> str:
        d = f"abs((shiftright({name}_a, {at}) & 15) - (shiftright({name}_b, {at}) & 15))"
        return f"least({d}, 16 - {d})"

    letters = " + ".join(part("marks", 4 * k) for k in range(len(SKETCH_LETTERS)))
    all_signs = "".join(f" AND {letters} + {' + '.join(part(m, 4 * k) for k in range(len(MORE_SIGNS)))} <= {2 * edits}" for m in more)
    return F.expr(f"{part('marks', LENGTH_AT)} <= {edits} AND {letters} <= {2 * edits}{all_signs}")


def _slots(edits: int) -> list[tuple[int, int]]:
    """(segment, places it is moved by) of the keys of a line in one class; those moved by none are its postings."""
    return [(i, shift) for i in range(edits + 1) for shift in range(-min(i, edits - i), min(i, edits - i) + 1)]


def _probes(slot: Column, edits: int) -> Column:
    """Whether the key at a slot is a probe."""
    slots = _slots(edits)
    return F.pmod(slot, F.lit(len(slots))).isin([k for k, (_, shift) in enumerate(slots) if shift])


def _place(i: int, shift: int, q: str, low: int, edits: int) -> tuple[str, str]:
    """SQL of (start from 0, length) of segment i in class q of lines of at least `low` characters; n is the line's length."""
    size = f"(greatest({low}, {low} + {q} * {SPAN} - {edits}) div {edits + 1})"
    start = f"({i} * {size} + {shift})" if i <= edits - i else f"(n - {edits + 1 - i} * {size} + {shift})"
    return f"int({start})", f"int({size})"


def _class(low: int) -> str:
    return f"int((n - {low}) div {SPAN})"


def _keys(line: str, group: str, low: int, edits: int) -> Column:
    """Array of the keys of a line of n characters, in the order of _slots, for its class and where needed for the next one; null where a moved segment would stand outside."""

    def one(q: str) -> str:
        keys = []
        for i, shift in _slots(edits):
            start, size = _place(i, shift, q, low, edits)
            keys.append(f"IF({start} >= 0 AND {start} + {size} <= n, xxhash64({group}, {q}, {i}, substring({line}, {start} + 1, {size})), null)")
        return f"array({', '.join(keys)})"

    q = _class(low)
    return F.expr(f"IF((n - {low}) % {SPAN} >= {SPAN - edits}, concat({one(q)}, {one(f'({q} + 1)')}), {one(q)})")


def _rest(line: str, slot: str, low: int, edits: int) -> Column:
    """The line with a line end in place of the segment of a slot."""
    slots = _slots(edits)
    cases = []
    for k in range(2 * len(slots)):
        i, shift = slots[k % len(slots)]
        start, size = _place(i, shift, _class(low) if k < len(slots) else f"({_class(low)} + 1)", low, edits)
        cases.append(f"WHEN {k} THEN concat(substring({line}, 1, {start}), '\\n', substring({line}, {start} + {size} + 1, n))")
    return F.expr(f"CASE {slot} {' '.join(cases)} END")


def _n_masks(n: Column, edits: int) -> Column:
    """How many masks a text of n characters has: at each of up to `edits` places a deletion or a sign out of sight."""
    out, places = F.lit(1.0), F.lit(1.0)
    for k in range(edits):
        places = places * F.greatest(n - k, F.lit(0)) * 2 / (k + 1)
        out = out + places
    return out


def _masks(text: str, edits: int) -> Column:
    """Array of (head, at, hidden, cut, before): masks of a text, whose characters from `at` on are still to be added to the head.

    A line end in the text is a mark that no edit touches.  A sign out of sight is a line end
    too; `before` of them stand before the mark, so that masks of two readings are not taken for one.
    """
    mark = F.instr(text, "\n")

    def edited(v: Column) -> Column:
        places = F.filter(F.sequence(v["at"] + 1, F.length(text)), lambda i: i != mark)
        places = F.when(v["at"] < F.length(text), places).otherwise(F.array().cast("array<int>"))

        def both(i: Column) -> Column:
            head = F.concat(v["head"], F.call_function("substring", F.col(text), v["at"] + 1, i - v["at"] - 1))
            hidden = F.struct(F.concat(head, F.lit("\n")).alias("head"), i.alias("at"), (v["hidden"] + 1).alias("hidden"), v["cut"].alias("cut"), (v["before"] + (i < mark).cast("int")).alias("before"))
            return F.array(hidden, F.struct(head.alias("head"), i.alias("at"), v["hidden"].alias("hidden"), (v["cut"] + 1).alias("cut"), v["before"].alias("before")))

        return F.flatten(F.transform(places, both))

    made = [F.array(F.struct(F.lit("").alias("head"), *(F.lit(0).alias(c) for c in ("at", "hidden", "cut", "before"))))]
    for _ in range(edits):
        made.append(F.flatten(F.transform(made[-1], edited)))
    return F.concat(*made)


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once; Spark evaluates every mention of a lambda's expression anew."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def banded_distance(a: Column, b: Column, edits: int) -> Column:
    """Edit distance of two texts of at least `edits` characters, exact up to `edits` and larger than that otherwise.

    A column of the distance matrix is held as two bit vectors, for the rows at which it goes
    up and down by one, over the 2 * edits + 1 rows beside the diagonal.  The vectors move
    down a row with every character of b; the distance is followed along the band's last
    row, and once that is the last row of the matrix, along it.
    """
    width = 2 * edits + 1
    every, last = (1 << width) - 1, 1 << (width - 1)
    texts = F.struct(F.slice(F.split(a, ""), F.lit(1), F.length(a)).alias("a"), F.slice(F.split(b, ""), F.lit(1), F.length(b)).alias("b"))
    found = _let(_trimmed(texts, edits), lambda t: _distance(t, edits, width, every, last))
    return F.when(F.abs(F.length(a) - F.length(b)) > edits, F.lit(edits + 1).cast("long")).otherwise(found)


def _common(a: Column, b: Column) -> Column:
    """Length of the common start of two arrays."""
    first = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    return F.when(first == 0, F.least(F.size(a), F.size(b))).otherwise(first - 1).cast("int")


def _trimmed(texts: Column, edits: int) -> Column:
    """Both character arrays (a, b) without their common start and end, but for `edits` characters of each, and their sizes (m, n)."""

    def with_start(t: Column) -> Column:
        shorter = F.least(F.size(t["a"]), F.size(t["b"]))
        end = F.least(_common(F.reverse(t["a"]), F.reverse(t["b"])), shorter - t["start"])
        return F.struct(t["a"].alias("a"), t["b"].alias("b"), F.greatest(t["start"] - edits, F.lit(0)).alias("start"), F.greatest(end - edits, F.lit(0)).alias("end"))

    def cut(t: Column) -> Column:
        m, n = F.size(t["a"]) - t["start"] - t["end"], F.size(t["b"]) - t["start"] - t["end"]
        return F.struct(F.slice(t["a"], t["start"] + 1, m).alias("a"), F.slice(t["b"], t["start"] + 1, n).alias("b"), m.alias("m"), n.alias("n"))

    started = _let(texts, lambda t: F.struct(t["a"].alias("a"), t["b"].alias("b"), _common(t["a"], t["b"]).alias("start")))
    return _let(_let(started, with_start), cut)


def _distance(t: Column, edits: int, width: int, every: int, last: int) -> Column:
    m = t["m"]

    def equal(j: Column) -> Column:
        def with_here(here: Column) -> Column:
            return reduce(lambda x, y: x + y, [F.when(F.get(t["a"], j - edits + k - 1) == here, F.lit(1 << k)).otherwise(F.lit(0)) for k in range(width)]).cast("long")

        return _let(F.get(t["b"], j - 1), with_here)

    columns = F.transform(F.sequence(F.lit(1), t["n"]), lambda j: F.struct(j.alias("j"), equal(j).alias("x")))
    start = F.struct(F.lit(((1 << (edits + 1)) - 1) << edits & every).cast("long").alias("up"), F.lit(0).cast("long").alias("down"), F.lit(edits).cast("long").alias("d"))

    def bit(vector: Column, at: Column) -> Column:
        return F.when(vector.bitwiseAND(at) != 0, F.lit(1)).otherwise(F.lit(0))

    def step(s: Column, c: Column) -> Column:
        up, down, x, j = s["up"], s["down"], c["x"], c["j"]
        same = (x.bitwiseAND(up) + up).bitwiseXOR(up).bitwiseOR(x).bitwiseOR(down).bitwiseAND(F.lit(every))

        def with_same(d0: Column) -> Column:
            def with_plus(plus: Column) -> Column:
                minus, moved = d0.bitwiseAND(up), F.shiftright(d0, 1)
                on_band = F.lit(1) - bit(d0, F.lit(last))
                row = F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(m - j + edits, F.lit(0)).cast("int"))
                d = s["d"] + F.when(j + edits <= m, on_band).otherwise(bit(plus, row) - bit(minus, row))
                risen = minus.bitwiseOR(F.bitwise_not(moved.bitwiseOR(plus))).bitwiseAND(F.lit(every))
                return F.struct(risen.alias("up"), moved.bitwiseAND(plus).alias("down"), d.cast("long").alias("d"))

            return _let(down.bitwiseOR(F.bitwise_not(d0.bitwiseOR(up))).bitwiseAND(F.lit(every)), with_plus)

        return _let(same, with_same)

    return F.aggregate(columns, start, step, lambda s: s["d"])


def _distinct_lines(keyed: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(lid, id, dk, dk2, pos, marks, keys): every distinct line where it occurs first, numbered; no text leaves the scan."""
    rows = keyed.select("id", *ROW, F.posexplode("ls").alias("pos", "line")).withColumn("n", F.length("line")).where(F.col("n") >= min_chars)
    rows = rows.select(*ROW, "id", "pos", F.xxhash64("line").alias("h1"), F.xxhash64("line", F.lit(1)).alias("h2"), _marks(F.col("line")).alias("marks"), _keys("line", "0", min_chars, edits).alias("keys"))
    first = rows.groupBy("h1", "h2").agg(F.min(F.struct("id", *ROW, "pos", "marks", "keys")).alias("f"))
    return first.select(F.monotonically_increasing_id().alias("lid"), "f.*")


def _meeting(lines: DataFrame) -> DataFrame:
    """(key, lid, marks): a row per key of a line, with the slot in its marks."""
    rows = lines.select("lid", "marks", F.posexplode("keys").alias("slot", "key")).where("key IS NOT NULL")
    return rows.select("key", "lid", (F.col("marks") + F.shiftleft(F.col("slot").cast("long"), SLOT_AT)).alias("marks"))


def _slot(marks: str) -> Column:
    return F.shiftright(marks, SLOT_AT).cast("int")


def _shared(met: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """(keys of two rows and more as (key, k), those of them with more than COMMON rows and more than one in HEAVY_KEYS of all `rows`); the second has fewer than HEAVY_KEYS rows."""
    keys = written(met.groupBy("key").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "keys")
    return keys, keys.where(F.col("k") > max(COMMON, rows // HEAVY_KEYS))


def _texts(at: DataFrame, keyed: DataFrame) -> DataFrame:
    """(lid, line) of lines (lid, dk, dk2, pos)."""
    by_doc = at.groupBy(*ROW).agg(F.collect_list(F.struct("pos", "lid")).alias("places"))
    rows = in_sieve(keyed, "dk", sieve(at, "dk")).where("held").join(by_doc, ROW).select("places", "ls")
    return rows.select(F.inline(F.transform("places", lambda p: F.struct(p["lid"].alias("lid"), F.get("ls", p["pos"]).alias("line"))))).dropDuplicates(["lid"])


def _of_lines(rows: DataFrame, at: DataFrame) -> DataFrame:
    """rows with the places of their lines; other lines than those of rows are sieved out before the join."""
    return rows.join(in_sieve(at, "lid", sieve(rows, "lid")).where("held").drop("held"), "lid")


def _order(x: str) -> Column:
    return F.struct(*(F.col(f"{c}_{x}") for c in ("id", *ROW, "pos")))


def _gone_by_pairs(pairs: DataFrame, at: DataFrame, keyed: DataFrame, edits: int) -> DataFrame:
    """(dk, dk2, pos) of the later line of each pair (a, b) of numbers that is near."""
    asked = written(_of_lines(pairs.select(F.explode(F.array("a", "b")).alias("lid")).distinct(), at), "asked-lines")
    known = asked.join(_texts(asked, keyed), "lid").withColumn("marks", _marks(F.col("line"))).withColumn("more", _sketch(F.col("line"), MORE_SIGNS))
    for x in "ab":
        pairs = pairs.join(known.select(*(F.col(c).alias(x if c == "lid" else f"{c}_{x}") for c in known.columns)), x)
    # more counts of signs than the meeting of keys has spare most pairs the distance, which Spark interprets
    pairs = pairs.where(_alike(edits, "more") & (banded_distance(F.col("line_a"), F.col("line_b"), edits) <= edits))
    a, b = _order("a"), _order("b")
    later = F.when(a < b, F.struct(*(F.col(f"{c}_b").alias(c) for c in (*ROW, "pos")))).otherwise(F.struct(*(F.col(f"{c}_a").alias(c) for c in (*ROW, "pos"))))
    return pairs.select(later.alias("x")).select("x.*")


def _star_pairs(common: DataFrame, heavy: DataFrame, edits: int) -> DataFrame:
    """(a, b) of each line of a common key with the first line of the key, if they may be near."""
    first = common.groupBy("key").agg(F.min(F.struct("id", *ROW, "pos", "lid", "marks", "probe")).alias("f"))
    first = first.select("key", *(F.col(f"f.{c}").alias(f"{c}_a") for c in ("lid", "marks", "probe")))
    rest = common.select("key", *(F.col(c).alias(f"{c}_b") for c in ("lid", "marks", "probe")))
    few = F.broadcast(heavy.select("key"))
    met = rest.join(few, "key", "left_anti").join(first, "key").unionByName(rest.join(F.broadcast(first.join(few, "key", "left_semi")), "key"))
    met = met.where(F.expr("NOT (probe_a AND probe_b) AND lid_a <> lid_b") & _alike(edits))
    return met.select(F.least("lid_a", "lid_b").alias("a"), F.greatest("lid_a", "lid_b").alias("b"))


#: What a row of a meeting of lines under common keys has besides its group.
HELD = ["lid", "marks", "probe", "probe2", "id", *ROW, "pos"]


def _meet(b: DataFrame, a: DataFrame, condition: Column, columns: list[str] = HELD, keep: str = "b") -> DataFrame:
    """Rows of one side (b or a, as `keep` says) that meet one of the other side, a before b, in a group and a pair of its parts."""
    own, every = F.pmod(F.xxhash64("lid"), F.col("parts")).cast("int"), F.explode(F.expr("sequence(0, parts - 1)"))
    b = b.select(F.col("group").alias("group_b"), F.col("parts").alias("parts_b"), own.alias("of_b"), every.alias("in_b"), *(F.col(c).alias(f"{c}_b") for c in columns))
    a = a.select(F.col("group").alias("group_a"), F.col("parts").alias("parts_a"), own.alias("in_a"), every.alias("of_a"), *(F.col(c).alias(f"{c}_a") for c in columns))
    same = (F.col("group_a") == F.col("group_b")) & (F.col("of_a") == F.col("of_b")) & (F.col("in_a") == F.col("in_b"))
    meets = F.expr("NOT (probe_a AND probe_b) AND NOT (probe2_a AND probe2_b)") & (_order("a") < _order("b"))
    x, y = (b, a) if keep == "b" else (a, b)
    found = x.join(y, same & meets & condition, "left_semi")
    return found.select(*(F.col(f"{c}_{keep}").alias(c) for c in ("group", "parts", *columns))).distinct()


def _hopeful(rows: DataFrame, n_rows: int, edits: int) -> tuple[DataFrame, DataFrame]:
    """(group, k) of the groups of rows (group, marks) for which masks may be less work than pairs, told without texts; and those of them with more than one in HEAVY_KEYS of n_rows.

    Letters of the sketch that a line has beyond those that all lines of its group have stand in the part that differs.
    """
    letters = [F.shiftright("marks", 4 * k).bitwiseAND(F.lit(15)) for k in range(len(SKETCH_LETTERS))]
    differ = F.floor(reduce(lambda a, b: a + b, [F.avg(c) - F.min(c) for c in letters]))
    found = rows.groupBy("group").agg(F.count(F.lit(1)).alias("k"), differ.alias("differ"))
    found = written(found.where(F.col("k") > F.greatest(F.lit(BLOCK), LINES_A_MASK * _n_masks(F.col("differ"), edits))).select("group", "k"), "hopeful-groups")
    return found, found.where(F.col("k") > max(BLOCK, n_rows // HEAVY_KEYS))


def _narrow(rows: DataFrame, n_rows: int, edits: int) -> tuple[DataFrame, DataFrame]:
    """(group, lead, trail, k) of the groups of rows (group, text) for which masks are less work than pairs; and those of them with more than one in HEAVY_KEYS of n_rows, fewer than HEAVY_KEYS.

    Texts of a group share their first `lead` and their last `trail` characters.
    """
    ends = {"lo": F.min("text"), "hi": F.max("text"), "end_lo": F.min(F.reverse("text")), "end_hi": F.max(F.reverse("text"))}
    size = {"k": F.count(F.lit(1)), "least": F.min(F.length("text")), "most": F.max(F.length("text"))}
    found = rows.groupBy("group").agg(*(c.alias(name) for name, c in (ends | size).items()))

    def shared(a: str, b: str) -> Column:
        x, y = (F.slice(F.split(c, ""), F.lit(1), F.length(c)) for c in (a, b))
        return _common(x, y)

    found = found.withColumn("lead", shared("lo", "hi")).withColumn("trail", F.least(shared("end_lo", "end_hi"), F.col("least") - F.col("lead")))
    left = F.col("most") - F.col("lead") - F.col("trail")
    found = written(found.where((left <= MASKED) & (F.col("k") > LINES_A_MASK * _n_masks(left, edits))).select("group", "lead", "trail", "k"), "narrow-groups")
    return found, found.where(F.col("k") > max(BLOCK, n_rows // HEAVY_KEYS))


def _of_groups(rows: DataFrame, groups: DataFrame, heavy: DataFrame, how: str = "inner") -> DataFrame:
    """rows of the groups (inner: with their columns) or of no group (left_anti); the heavy ones of the groups are broadcast."""
    few = F.broadcast(heavy)
    rest = rows.join(F.broadcast(heavy.select("group")), "group", "left_anti").join(groups.join(F.broadcast(heavy.select("group")), "group", "left_anti"), "group", how)
    return rest.unionByName(rows.join(few, "group")) if how == "inner" else rest


def _gone_by_masks(rows: DataFrame, edits: int) -> DataFrame:
    """(ord) of the open rows (group, text, ord, open) that share a mask with one of smaller ord at `edits` edits or fewer: those that one edit settles first."""
    gone = rows.where("false").select("ord")
    for budget in range(1, edits + 1):
        made = rows.select("group", "text", "ord", "open", F.explode(_masks("text", budget)).alias("m"))
        mask = F.concat("m.head", F.expr("substring(text, m.at + 1, length(text))"))
        keys = [F.xxhash64("group", mask, "m.before").alias("m1"), F.xxhash64("m.before", mask, "group", F.lit(1)).alias("m2")]
        made = made.select(*keys, F.col("m.cut").alias("cut"), (F.lit(budget) - F.col("m.hidden") - F.col("m.cut")).alias("spare"), "ord", "open")
        asked = made.where("open").select("m1", "m2", "spare", "ord")
        if budget > 1:
            made = in_sieve(made, "m1", sieve(asked, "m1")).where("held")
        least = made.groupBy("m1", "m2").agg(*(F.min(F.when(F.col("cut") <= t, F.col("ord"))).alias(f"first{t}") for t in range(budget + 1)))
        first = F.get(F.array(*(F.col(f"first{t}") for t in range(budget + 1))), F.col("spare"))
        found = written(asked.join(least, ["m1", "m2"]).where(first < F.col("ord")).select("ord").distinct(), "masked-gone")
        gone = gone.unionByName(found)
        if budget < edits:
            left = rows.join(found.withColumn("found", F.lit(True)), "ord", "left").withColumn("open", F.col("open") & F.col("found").isNull()).drop("found")
            rows = written(left, "masked-left")
    return gone


def _settle(rows: DataFrame, n_rows: int, edits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The groups that masks are made for, the heavy ones of them, and (lid) of their open rows (group, text, lid, id, dk, dk2, pos, open) that an earlier one is near to."""
    order = ["id", *ROW, "pos"]
    narrow, heavy = _narrow(rows, n_rows, edits)
    core = F.expr("substring(text, lead + 1, length(text) - lead - trail)")
    cut = written(_of_groups(rows, narrow, heavy).select("group", core.alias("text"), "open", "lid", *order), "narrow-rows")
    # numbers in the order of lines, so that the first of many is a minimum of longs
    numbers = written(cut.select("lid", *order).distinct().orderBy(*order).select("lid", F.monotonically_increasing_id().alias("ord")), "line-order")
    # a hot group's rows are spread before their masks are made
    spread = written(cut.select("group", "text", "open", "lid").join(numbers, "lid").drop("lid").repartition("ord"), "numbered-rows")
    return narrow, heavy, _gone_by_masks(spread, edits).distinct().join(numbers, "ord").select("lid")


def _gone_in_common(common: DataFrame, gone: DataFrame, keyed: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(dk, dk2, pos) of the lines, beside those that are gone, that have an earlier one near under a common key.

    Both lines of a near pair are near without the segment they share, so they meet under a
    key of that as well.  Lines that are near on either side of it are near as a whole.
    """
    common = common.join(gone.distinct().withColumn("gone", F.lit(True)), [*ROW, "pos"], "left").withColumn("open", F.col("gone").isNull()).drop("gone")
    large = common.where(F.col("k") > BLOCK).withColumnRenamed("key", "group").drop("k")
    held = ["open", *(c for c in HELD if c != "probe2")]
    settled, dealt = [], None

    def rests_of(rows: DataFrame, lines: DataFrame) -> DataFrame:
        return rows.join(lines.withColumn("n", F.length("line")), "lid").select("group", *held, _rest("line", "slot", min_chars, edits).alias("text"))

    if not large.isEmpty():
        known = _texts(written(large.select("lid", *ROW, "pos").distinct(), "common-lines"), keyed)
        n_large = large.count()
        hopeful, top = _hopeful(large, n_large, edits)
        if not hopeful.isEmpty():
            known = written(known, "large-texts")
            tried = written(rests_of(_of_groups(large, hopeful, top), known), "large-rests")
            narrow, top, found = _settle(tried, n_large, edits)
            settled.append(found)
            large = _of_groups(large, narrow, top, "left_anti")
        posts = rests_of(large, known).withColumn("bare", F.translate("text", "\n", "")).withColumn("n", F.length("bare"))
        posts = posts.select(*held, "text", F.posexplode(_keys("bare", "group", 0, edits)).alias("slot2", "key")).where("key IS NOT NULL").withColumn("probe2", _probes(F.col("slot2"), edits))
        rests = written(posts.select("probe2", "key", *held), "common-rests")
        n_rests = rests.count()
        shared, heavy = _shared(rests, n_rests)
        again = rests.join(shared.where(F.col("k") > BLOCK).select("key"), "key").select(F.col("key").alias("group"), "marks")
        hopeful, top = _hopeful(again, n_rests, edits)
        rests = rests.withColumnRenamed("key", "group")
        if not hopeful.isEmpty():
            tried = written(_of_groups(posts.select(F.col("key").alias("group"), *held, "text"), hopeful, top), "second-rests").drop("k")
            narrow, top, found = _settle(tried, n_rests, edits)
            settled.append(found)
            rests = _of_groups(rests, narrow, top, "left_anti")
        parts = heavy.select(F.col("key").alias("group"), F.ceil(F.col("k") / BLOCK).cast("int").alias("parts"))
        dealt = rests.join(F.broadcast(parts), "group", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = common.where(F.col("k") <= BLOCK).select(F.col("key").alias("group"), F.lit(1).alias("parts"), F.lit(False).alias("probe2"), "open", *(c for c in HELD if c != "probe2"))
    if dealt is not None:
        rows = rows.unionByName(dealt)
    done = written(reduce(DataFrame.unionByName, settled).distinct(), "settled") if settled else None
    if done is not None:
        rows = rows.join(done.withColumn("settled", F.lit(True)), "lid", "left").withColumn("open", F.col("open") & F.col("settled").isNull()).drop("settled")
    rows = written(rows, "common-rows")
    later = written(_meet(rows.where("open"), rows, _alike(edits)), "common-later")
    earlier = written(_meet(later, rows, _alike(edits), keep="a"), "common-earlier")
    asked = written(later.unionByName(earlier).select("lid", *ROW, "pos").distinct(), "common-asked")
    lines = written(_texts(asked, keyed).withColumn("more", _sketch(F.col("line"), MORE_SIGNS)), "common-texts")
    near = _alike(edits, "more") & (banded_distance(F.col("line_a"), F.col("line_b"), edits) <= edits)
    out = _meet(later.join(lines, "lid"), earlier.join(lines, "lid"), near, [*HELD, "line", "more"]).select(*ROW, "pos")
    return out.unionByName(common.join(done, "lid", "left_semi").select(*ROW, "pos").distinct()) if done is not None else out


def similar_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(first occurrences (dk, dk2, pos), those of them that have an earlier line within `edits` edits; a place may come twice)."""
    keyed = _keyed(docs, id_col, text_col).select("id", *ROW, _lines(F.col("text")).alias("ls"))
    lines = written(_distinct_lines(keyed, edits, min_chars), "lines")
    at = lines.select("lid", "id", *ROW, "pos")
    met = _meeting(lines)
    shared, heavy = _shared(met, lines.agg(F.sum(F.size("keys"))).first()[0] or 0)
    top = F.broadcast(heavy)
    light = written(met.join(top.select("key"), "key", "left_anti").join(shared, "key"), "meetings").withColumn("probe", _probes(_slot("marks"), edits))
    few = light.where(F.col("k") <= COMMON)
    a, b = (few.select("key", *(F.col(c).alias(f"{c}_{x}") for c in ("lid", "marks", "probe"))) for x in "ab")
    # a posting meets the probes of its key and the later postings
    meets = F.expr("NOT probe_a AND (probe_b OR lid_a < lid_b) AND lid_a <> lid_b")
    pairs = a.join(b, "key").where(meets & _alike(edits)).select(F.least("lid_a", "lid_b").alias("a"), F.greatest("lid_a", "lid_b").alias("b"))
    common = light.where(F.col("k") > COMMON).unionByName(met.join(top, "key").withColumn("probe", _probes(_slot("marks"), edits)))
    if common.isEmpty():
        return at.drop("lid", "id"), written(_gone_by_pairs(written(pairs.distinct(), "line-pairs"), at, keyed, edits), "lines-gone")
    common = written(_of_lines(common, at).withColumn("slot", _slot("marks")), "common")
    pairs = written(pairs.unionByName(_star_pairs(common, heavy, edits)).distinct(), "line-pairs")
    gone = written(_gone_by_pairs(pairs, at, keyed, edits), "lines-gone")
    return at.drop("lid", "id"), gone.unionByName(written(_gone_in_common(common, gone, keyed, edits, min_chars), "common-gone"))


def dedup_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(dk, dk2, id_col, text_col, n_lines, n_kept): the documents with the lines that stay.

    A null text stays null and has no lines, an empty one is one short line.  Rows that
    repeat id and text are one document in two rows and get the same result; a null id comes
    before all others.  Characters are code points.  Texts and lines may be of any length: the
    work on a text grows with its length, that on a line too.  An empty table gives no rows.
    """
    first, gone = similar_lines(docs, edits, min_chars, id_col, text_col)
    place = F.xxhash64(*ROW, "pos").alias("place")
    marked = in_sieve(first.withColumn("place", place), "place", sieve(gone.select(place), "place"))
    kept = marked.where("NOT held").select(*ROW, "pos").unionByName(marked.where("held").select(*ROW, "pos").join(gone.distinct(), [*ROW, "pos"], "left_anti"))
    kept = kept.groupBy(*ROW).agg(F.collect_list("pos").alias("places"))
    kept = written(kept, "lines-kept")
    keyed = _keyed(docs, id_col, text_col).withColumn("ls", _lines(F.col("text")))
    # a document loses a line unless all its long lines are among those that stay
    n_long = keyed.select(*ROW, F.size(F.filter("ls", lambda x: F.length(x) >= min_chars)).alias("n_long")).where("n_long > 0")
    losing = n_long.join(kept.select(*ROW, F.size("places").alias("n_places")), ROW, "left").where("n_long <> coalesce(n_places, 0)").select("dk")
    rows = in_sieve(keyed, "dk", written(sieve(losing, "dk"), "losing"))
    n_lines = F.coalesce(F.size("ls"), F.lit(0)).cast("long").alias("n_lines")
    whole = rows.where("NOT held").select(*ROW, F.col("id").alias(id_col), F.col("text").alias(text_col), n_lines, n_lines.alias("n_kept"))
    found = rows.where("held").join(kept, ROW, "left").withColumn("places", F.coalesce("places", F.array().cast("array<int>")))
    short = F.filter(F.transform("ls", lambda x, i: F.when(F.length(x) < min_chars, i)), lambda i: i.isNotNull())
    found = found.select(*ROW, "id", "ls", F.array_sort(F.concat(short, "places")).alias("stay"))
    found = found.withColumn("kept", F.transform("stay", lambda i: F.get("ls", i)))
    n_kept = F.coalesce(F.size("kept"), F.lit(0)).cast("long").alias("n_kept")
    return whole.unionByName(found.select(*ROW, F.col("id").alias(id_col), F.array_join("kept", "\n").alias(text_col), n_lines, n_kept))


def apply(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with all their columns, whatever their names, and the deduplicated text; a document that had a text and lost all its lines is left out."""
    k1, k2, new_text = fresh(docs, "k1", "k2", "text")
    new = dedup_lines(docs, edits, min_chars, id_col, text_col)
    new = new.where((F.col("n_kept") > 0) | F.col(text_col).isNull()).select(F.col("dk").alias(k1), F.col("dk2").alias(k2), F.col(text_col).alias(new_text)).dropDuplicates([k1, k2])
    rest = docs.select("*", *(c.alias(k) for c, k in zip(row_key(id_col, text_col), (k1, k2), strict=True)))
    return rest.join(new, [k1, k2]).select(*(F.col(new_text).alias(c) if c == text_col else F.col(c) for c in docs.columns))
