"""Folds in blocks, as-of joins, event rules and unique inserts against plain loops."""

import collections
import random

import pytest
from pyspark.sql import functions as F

from planwalk.operators import positioning, sessions, tables
from planwalk.plans import session_queries

SF = "/root/testdata/sf0.001"


def plain_fold(actions):
    state, good, bad = "CREATED", 0, 0
    for action in actions:
        after = next((target for name, sources, target in sessions.TRANSITIONS if name == action and state in sources), state)
        good, bad, state = good + (after != state), bad + (after == state), after
    return state, good, bad


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_folds_in_blocks_equal_a_loop(spark, block):
    rng = random.Random(block)
    names = [t[0] for t in sessions.TRANSITIONS]
    runs = {k: [rng.choice([*names, "START", "PAUSE", "RESUME", None]) for _ in range(rng.randint(1, 40))] for k in range(30)}
    rows = [(k, 5 + n, a) for k, run in runs.items() for n, a in enumerate(run)]
    rng.shuffle(rows)
    found = sessions.fold(spark.createDataFrame(rows, "s long, call_no long, action string"), "s", block=block).collect()
    assert {r["s"]: (r["state"], r["n_accepted"], r["n_rejected"]) for r in found} == {k: plain_fold(run) for k, run in runs.items()}


def test_as_of_equals_a_loop(spark):
    rng = random.Random(2)
    when = lambda: f"2026-01-{rng.randint(1, 6):02d} {rng.choice(['00:00:00', '12:00:00', '23:59:59'])}"
    calls = [(rng.randint(1, 4), when(), k) for k in range(120)]
    readings = [(rng.randint(1, 5), when(), rng.randint(0, 120), float(k)) for k in range(50)]
    c = spark.createDataFrame(calls, "s long, t string, k long").withColumn("t", F.to_timestamp("t"))
    r = spark.createDataFrame(readings, "s long, t string, k long, x double").withColumn("t", F.to_timestamp("t"))
    found = {row["k"]: row["x"] for row in positioning.as_of(c, r, "s", "t", "k", ["x"]).collect()}
    for s, t, k in calls:
        near = [(rt, rk, x) for rs, rt, rk, x in readings if rs == s and (rt, rk) <= (t, k)]
        best = max(near, default=(None, None, None))
        assert found[k] in {x for rt, rk, x in near if (rt, rk) == best[:2]} or (not near and found[k] is None)
    assert len(found) == 120 and positioning.as_of(c, r.where("false"), "s", "t", "k", ["x"]).where("x IS NOT NULL").count() == 0


def test_every_event_rule_is_broken_somewhere(spark):
    told = {r["check_name"] for r in session_queries.event_batch_audit(spark, SF).select("check_name").distinct().collect()}
    assert told == {"unsupported_type", "duplicate_type", "missing_field", "order", "destination_not_completed", "floor_changed", "completed_without_entered", "node_without_entered", "cancelled_state"}


def test_sound_batches_have_no_faults(spark):
    events = [(1, p, t, 1, "N") for p, t in enumerate(("SessionStarted", "SegmentEntered", "SegmentCompleted", "NodeReached", "DestinationReached"))] + [(2, 0, "SessionCancelled", None, None)]
    e = spark.createDataFrame(events, "b long, place long, event_type string, segment long, node string")
    b = spark.createDataFrame([(1, "ACTIVE", True), (2, "CANCELLED", False)], "b long, state string, completed boolean")
    faults = sessions.batch_audit(e, b, "b")
    assert faults.count() == 0 and [r["valid"] for r in sessions.batch_reports(faults, e, "b").collect()] == [True, True]


def test_unique_inserts_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(tables, "KEY_BITS", 64)  # bits collide
    rng = random.Random(3)
    key = lambda: (rng.choice(["a", "b", None]), rng.randint(0, 9))
    held = [key() for _ in range(12)]
    new = [(*key(), rng.randint(0, 3)) for _ in range(80)] + [("hot", 1, 1)] * 40
    taken, left = tables.insert_unique(spark.createDataFrame(held, "g string, k int"), spark.createDataFrame(new, "g string, k int, v int"), "g", "k")
    known, wanted = set(held), []
    for row in sorted(new, key=lambda r: (r[0] is not None, r[0] or "", *r[1:])):
        if row[:2] not in known:
            wanted.append(row)
            known.add(row[:2])
    got = [tuple(r) for r in taken.collect()]
    assert sorted(map(str, got)) == sorted(map(str, wanted))
    assert collections.Counter(got) + collections.Counter(tuple(r) for r in left.collect()) == collections.Counter(new)
