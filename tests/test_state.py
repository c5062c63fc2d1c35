import datetime
import random
from unittest import mock

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lorestream.streaming import state as S

START = datetime.datetime(2024, 3, 1)


def events(seed, n=120, users=4):
    rng = random.Random(seed)
    t, out = 0.0, []
    for i in range(n):
        t += rng.choice([0, 1, 50, 900, 5000])
        out.append((rng.randrange(users), START + datetime.timedelta(seconds=t), i, rng.random() < 0.2, rng.choice("abc")))
    return out


SCHEMA = "user_id long, ts timestamp, seq long, is_upload boolean, cache_key string"


def feed(spark, rows, at, parts):
    """Files of rows in order of time; returns the stream over the folder and a writer of the next file."""
    size = -(-len(rows) // parts)
    files = [rows[i : i + size] for i in range(0, len(rows), size)]

    def write(i):
        spark.createDataFrame(files[i], SCHEMA).coalesce(1).write.mode("append").parquet(at)

    return len(files), write, lambda: spark.readStream.schema(SCHEMA).parquet(at)


def run(spark, rows, tmp_path, parts, make):
    """All rows in one run, or file by file with a restart from the checkpoint before each."""
    n, write, stream = feed(spark, rows, str(tmp_path / f"in{parts}"), parts)
    for i in range(n):
        write(i)
        at = S.run_to_end(lambda: make(stream()), str(tmp_path / f"out{parts}"))
    return sorted((tuple(r) for r in spark.read.parquet(at).collect()), key=str)


@pytest.mark.parametrize("seed", [1])
def test_one_run_equals_restarts(spark, tmp_path, seed):
    rows = events(seed)
    cases = {
        "lives": lambda s: S.session_lifetimes(s.select(F.col("user_id").alias("session_id"), "ts", "seq", F.col("cache_key").alias("payload")), 3600, "10 seconds"),
        "docs": lambda s: S.session_documents(s.withColumnRenamed("user_id", "session_id"), 7200, "10 seconds"),
        "cache": lambda s: S.cached_answers(s, 1, "10 seconds"),
        "limit": lambda s: S.limited(s, 2, 3000, "10 seconds"),
    }
    for name, make in list(cases.items())[:: 1 if seed == 1 else 2]:
        whole = run(spark, rows, tmp_path / name, 1, make)
        assert whole and whole == run(spark, rows, tmp_path / name, 2, make), name
    if seed == 1:
        assert run(spark, rows, tmp_path / "again", 1, cases["limit"]) == expected_limits(rows)


def expected_limits(rows):
    held, out = {}, []
    for user, ts, seq, *_ in rows:
        live = [t for t in held.get(user, []) if t > ts - datetime.timedelta(seconds=3000)]
        out.append((user, seq, len(live) < 2))
        held[user] = live + [ts] * out[-1][2]
    return sorted(out, key=str)


def test_a_replayed_run_adds_nothing(spark, tmp_path):
    rows = events(3, 40)
    make = lambda s: S.cached_answers(s, 1, "10 seconds")
    n, write, stream = feed(spark, rows, str(tmp_path / "in"), 1)
    write(0)
    for _ in range(2):
        at = S.run_to_end(lambda: make(stream()), str(tmp_path / "out"))
    assert spark.read.parquet(at).count() == 40
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_a_batch_of_a_user_costs_the_cache_three_calls_of_the_store():
    cache, handle = S.Cache(10), mock.Mock()
    cache.init(handle)
    stored = handle.getValueState.return_value
    rows = lambda us: iter([pd.DataFrame({"us": us, "seq": range(len(us)), "cache_key": list("abcdefgh"[: len(us)])})])
    stored.get.return_value = None
    assert next(cache.handleInputRows((7,), rows([5, 1, 3]), None)).seq.tolist() == [1, 2, 0]
    assert (handle.method_calls[1:], stored.method_calls) == ([mock.call.registerTimer(1)], [mock.call.get(), mock.call.update((["b", "c", "a"], [1, 3, 5]))])
    stored.get.return_value = (["b", "a"], [1, 5])
    assert next(cache.handleInputRows((7,), rows([12, 11]), None)).hit.tolist() == [True, True]
    assert handle.method_calls[2:] == [] and len(stored.method_calls) == 4
    timer = mock.Mock(getExpiryTimeInMs=lambda: 1)
    stored.get.return_value = (["b", "a"], [1, 995])
    assert list(cache.handleExpiredTimer((7,), None, timer)) == [] and stored.method_calls[-1] == mock.call.update((["a"], [995]))
    stored.get.return_value = (["b"], [1])
    assert list(cache.handleExpiredTimer((7,), None, timer)) == [] and stored.method_calls[-1] == mock.call.clear()


def test_fold_over_two_runs(spark, tmp_path):
    schema = "conv_id long, turn long, role string, text string"
    turns = [(c, t, "assistant" if t % 2 else "user", f"{c}.{t} " * (1 if t < 4 else 200)) for c in (1, 2) for t in range(8)]
    turns += [(1, 8, "user", None), (1, 9, "assistant", None)]
    for low, high in ((0, 5), (5, 10)):
        spark.createDataFrame([t for t in turns if low <= t[1] < high], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        at = S.run_to_end(lambda: S.folded(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), most=3), str(tmp_path / "out"))
    got = {(r.conv_id, r.turn_id): r for r in spark.read.parquet(at).collect()}
    assert len(got) == 9 and [got[1, i].pushed_out for i in range(1, 6)] == [None, None, None, 1, 2]
    assert [got[1, i].held for i in range(1, 6)] == [1, 2, 3, 3, 3]
    assert got[2, 1].query == "2.0 " and got[2, 1].summary == "2.1 " and got[2, 3].summary == ""
    long = got[2, 3].answer
    assert long.endswith("...") and len(long) <= 503 and not long[:-3].endswith(" ")
    assert (got[1, 5].query, got[1, 5].answer) == ("", "")


def expected_jobs(rows, now, timeout, keep, attempts):
    """Each job's events in order, with what falls due between them, up to the watermark."""
    out, final = [], ("succeeded", "failed", "timed_out")
    for user in sorted({r[0] for r in rows}):
        state = attempt = until = None
        for t, kind in [*((r[1], r[4]) for r in rows if r[0] == user), (now, None)]:
            if state and state not in final and t > until:
                out.append((user, until, "timed_out", attempt))
                state, until = "timed_out", until + keep
            if state in final and t > until:
                state = None
            before = state
            if kind == "created" and state is None:
                state, attempt, until = "queued", 0, t + timeout
            elif kind == "started" and state in ("queued", "retrying"):
                state, attempt = "running", attempt + 1
            elif kind == "failed" and state == "running":
                state = "retrying" if attempt < attempts else "failed"
            elif kind == "succeeded" and state == "running":
                state = "succeeded"
            if state != before:
                out.append((user, t, state, attempt))
                until = t + keep if state in final else until
    return sorted(out, key=str)


def test_jobs_equal_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(*r[:4], rng.choice(["created", "created", "started", "started", "failed", "succeeded", "other"])) for r in events(7, 300, 5)]
    make = lambda s: S.job_states(s.select(F.col("user_id").alias("job_id"), "ts", "seq", F.col("cache_key").alias("event")), 40_000, 15_000, 2, "10 seconds")
    whole = run(spark, rows, tmp_path / "jobs", 1, make)
    seconds = lambda n: datetime.timedelta(seconds=n)
    want = expected_jobs(rows, max(r[1] for r in rows) - seconds(10), seconds(40_000), seconds(15_000), 2)
    assert whole == want and {r[2] for r in want} == {"queued", "running", "retrying", "succeeded", "failed", "timed_out"}
    assert whole == run(spark, rows, tmp_path / "jobs", 2, make)


def test_sessions_that_end_within_a_millisecond_of_the_watermark(spark, tmp_path):
    import duckdb

    from lorestream.plans import stateful

    # Ends half a millisecond before the last event less ten minutes, half a millisecond after it, and at it; and one whose life ended by a later write.
    last = START + datetime.timedelta(microseconds=700)
    ends = [-500, 500, 0]
    rows = [(i, i, last - datetime.timedelta(seconds=7800) + datetime.timedelta(microseconds=d), "x") for i, d in enumerate(ends)]
    rows += [(8, 8, START - datetime.timedelta(hours=9), "y"), (9, 8, last, "z")]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute("select session_id, expires, writes, payload from (" + stateful._LIVES.format(7200) + " select * from l where expires < (select max(ts) - interval 10 minute from events)) order by 1").fetchall()
    got = stateful.session_lifetimes(spark, str(tmp_path)).select("session_id", "expires", "writes", "payload").orderBy("session_id").collect()
    assert [tuple(r) for r in got] == want and [r[0] for r in want] == [0, 8]
