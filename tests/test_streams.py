"""Streams over shuffled events, in one file and in a folder of part files, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from planwalk.operators.sessions import TRANSITIONS
from planwalk.plans import stream_queries
from planwalk.streaming import sessions

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string"
ACTION = {"view": "START", "click": "PAUSE", "signup": "RESUME", "error": "CANCEL"}


@pytest.fixture(scope="module")
def events(spark):
    """30000 events in no order, half of them of one session."""
    rng = random.Random(5)
    hour = lambda k: f"timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, {k}, 0)"
    rows = [(k, rng.randrange(20000), 1 if k % 2 else rng.randrange(50), rng.choice([*ACTION, "purchase"])) for k in range(30000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "event_id long, minute int, user_id long, event_type string")
    return df.select("event_id", F.expr(hour("minute")).alias("ts"), "user_id", "event_type"), rows


def stored(events, tmp_path, parts):
    """The folder of the tables, with events as a single file or as a folder of part files."""
    out = tmp_path / "events.parquet"
    if parts > 1:
        events.repartition(parts).write.parquet(str(out))
    else:
        events.coalesce(1).write.parquet(str(tmp_path / "whole"))
        next((tmp_path / "whole").glob("*.parquet")).rename(out)
    return str(tmp_path)


def followed(rows):
    """event_id: (call_no, state, accepted), session by session."""
    out, now = {}, {}
    for e, _, s, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        n, state = now.get(s, (0, "CREATED"))
        after = next((t for a, sources, t in TRANSITIONS if a == ACTION.get(kind, "COMPLETE") and state in sources), None)
        now[s] = (n + 1, after or state)
        out[e] = (*now[s], after is not None)
    return out


@pytest.mark.parametrize("parts", [1, 3])
def test_calls_in_no_order(spark, events, tmp_path, parts):
    df, rows = events
    sf, wanted = stored(df, tmp_path, parts), followed(rows)
    steps = {r["event_id"]: r["call_no"] for r in stream_queries.stream_walk_steps(spark, sf).collect()}
    assert steps == {e: v[0] for e, v in wanted.items()}
    states = {r["event_id"]: (r["state"], r["accepted"]) for r in stream_queries.stream_session_fsm(spark, sf).collect()}
    assert states == {e: v[1:] for e, v in wanted.items()}


@pytest.mark.parametrize("parts", [1, 3])
def test_windows_of_all_files(spark, events, tmp_path, parts):
    df, rows = events
    found = stream_queries.stream_window_counts(spark, stored(df, tmp_path, parts)).collect()
    assert sum(r["n"] for r in found) == len(rows)
    assert len(found) == len({(m // 60, kind) for _, m, _, kind in rows})


def test_later_batches_carry_on(spark):
    kinds = ["START", "PAUSE", "RESUME", "PAUSE", "COMPLETE"]
    calls = spark.createDataFrame([(s, 10 * k + (s or 0), k, a) for s in (1, 2, None) for k, a in enumerate(kinds)], "session_id long, event_id long, ts int, action string")
    for step, held, column, wanted in ((sessions.walk_batch, "long", "call_no", [1, 2, 3, 4, 5]), (sessions.lifecycle_batch, "string", "state", ["ACTIVE", "PAUSED", "ACTIVE", "PAUSED", "PAUSED"])):
        first, kept = step(calls.where("ts < 2"), spark.createDataFrame([], f"session_id long, held {held}"))
        middle, kept = step(calls.where("ts = 2 AND session_id = 1"), kept)
        last, kept = step(calls.where("ts > 2 OR ts = 2 AND NOT session_id <=> 1"), kept)
        rows = first.unionByName(middle).unionByName(last).orderBy("event_id").collect()
        for s in (1, 2, None):
            assert [r[column] for r in rows if r["session_id"] == s] == wanted
        assert {(r["session_id"], r["held"]) for r in kept.collect()} == {(s, wanted[-1]) for s in (1, 2, None)}


def test_streams_resume_from_their_folder(spark, tmp_path):
    """Files that come later are taken by streams started again; state of untouched buckets stays where it was written."""
    rng = random.Random(8)
    rows = [(k, k, rng.randrange(12) if k < 300 else 3, rng.choice(["START", "PAUSE", "RESUME", "CANCEL", "COMPLETE"])) for k in range(400)]
    schema = "event_id long, ts int, session_id long, action string"
    wanted, now = {}, {}
    for e, _, s, a in rows:
        n, state = now.get(s, (0, "CREATED"))
        after = next((t for name, sources, t in TRANSITIONS if name == a and state in sources), None)
        now[s] = (n + 1, after or state)
        wanted[e] = (*now[s], after is not None)
    source, walk_at, life_at = (f"file://{tmp_path}/{n}" for n in ("in", "walk", "life"))
    for low, high in ((0, 150), (150, 300), (300, 350), (350, 400), (400, 400)):
        if low < high:
            spark.createDataFrame(rows[low:high], schema).coalesce(1).write.mode("append").parquet(source)
        calls = spark.readStream.schema(schema).parquet(source)
        steps = sessions.walk(calls.drop("action"), walk_at).collect()
        assert {r["event_id"]: r["call_no"] for r in steps} == {e: wanted[e][0] for e in range(high)} and len(steps) == high
        states = sessions.lifecycle(calls, life_at).collect()
        assert {r["event_id"]: (r["state"], r["accepted"]) for r in states} == {e: wanted[e][1:] for e in range(high)}
    # the last batches hold calls of one session alone
    for kept in ("walk/kept-2", "walk/kept-3", "life/kept-3"):
        assert len(list((tmp_path / kept).glob("bucket=*"))) == 1
    assert not list((tmp_path / "walk/kept-0").glob("bucket=*"))


def test_a_batch_cut_off_is_run_again(spark, tmp_path):
    schema, folder = "session_id long, event_id long, ts int", f"file://{tmp_path}/walk"
    source = f"file://{tmp_path}/in"
    spark.createDataFrame([(1, 1, 1), (2, 2, 2)], schema).coalesce(1).write.mode("append").parquet(source)
    calls = spark.readStream.schema(schema).parquet(source)
    sessions.walk(calls, folder)
    spark.createDataFrame([(1, 3, 3)], schema).coalesce(1).write.mode("append").parquet(source)
    failing = {"left": 1}

    def once(batch, kept):
        rows, keep = sessions.walk_batch(batch, kept)
        if failing["left"]:
            failing["left"] = 0
            rows.write.mode("overwrite").parquet(f"{folder}/rows-1")
            raise RuntimeError("lost")
        return rows, keep

    columns = "session_id long, event_id long, call_no long"
    with pytest.raises(Exception, match="lost"):
        sessions.drained_calls(calls, once, "long", columns, "walk", folder)
    found = sessions.drained_calls(calls, once, "long", columns, "walk", folder).collect()
    assert sorted(tuple(r) for r in found) == [(1, 1, 1), (1, 3, 2), (2, 2, 1)]
