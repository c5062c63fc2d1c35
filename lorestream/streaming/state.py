"""Keyed state over streams: sessions that expire, uploads that replace each other, cached answers, folded conversations.

Each is a stateful processor run by `transformWithStateInPandas`, in event time. A
batch's rows of one key are put in order of time before they meet the state, so
one batch or many give the same rows as long as rows come within the watermark.
Timers take state away when it can no longer matter; what a key holds is a value,
a map of live entries or the last turns, never its history. A batch's rows of one
key pass one task: bound batches by files (`maxFilesPerTrigger`) where keys are hot.

The state store must be one with column families; `run_to_end` sets RocksDB's for
the query it starts and no other.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_to_end(make: Callable[[], DataFrame], at: str, mode: str = "append") -> str:
    """Run a stream over all that its source has now; returns the folder of its parquet output. `at` keeps its checkpoint."""
    out = make()
    spark = out.sparkSession
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        query = out.writeStream.format("parquet").outputMode(mode).option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    finally:
        spark.conf.set(_PROVIDER, before)
    query.awaitTermination()
    return f"{at}/rows"


def place(spark: SparkSession, name: str) -> str:
    """A new folder for a stream or a store, in the folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lorestream-"))
        shared = spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/lorestream-{name}-{uuid.uuid4().hex}"


def written(rows: DataFrame, name: str) -> DataFrame:
    """rows, computed once: written to a new folder that driver and executors share, and read from there however often."""
    at = place(rows.sparkSession, name)
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def _ordered(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    held = list(frames)
    frame = held[0] if len(held) == 1 else pd.concat(held)
    return frame.iloc[np.lexsort((frame["seq"].to_numpy(), frame["us"].to_numpy()))]


def _timed(rows: DataFrame, late: str) -> DataFrame:
    """rows with their watermark and their time in microseconds, whatever the session's time zone."""
    return rows.withWatermark("ts", late).withColumn("us", F.unix_micros("ts"))


def _told(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.timestamp_micros(c) for c in columns})


def _rearm(handle: StatefulProcessorHandle, us: int) -> None:
    """One timer, that fires when the watermark has passed this time."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    handle.registerTimer(us // 1000 + 1)


class Lifetimes(StatefulProcessor):
    """A write keeps a session alive for `ttl` microseconds; each life is told when it is over."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "started long, last long, writes long, payload string")

    def _rows(self, key: tuple, lives: list[tuple]) -> pd.DataFrame:
        started, last, writes, payload = zip(*lives)
        return pd.DataFrame({"session_id": key[0], "started": started, "last_write": last, "expires": [at + self.ttl for at in last], "writes": writes, "payload": payload})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        life, over = tuple(self.life.get()) if self.life.exists() else None, []
        for us, payload in _ordered(rows)[["us", "payload"]].itertuples(index=False):
            if life and us > life[1] + self.ttl:
                over.append(life)
                life = None
            life = (life[0] if life else us, us, life[2] + 1 if life else 1, payload)
        self.life.update(tuple(life))
        _rearm(self.handle, life[1] + self.ttl)
        if over:
            yield self._rows(key, over)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.life.exists():
            yield self._rows(key, [tuple(self.life.get())])
            self.life.clear()

    def close(self) -> None:
        pass


LIFETIMES = "session_id long, started long, last_write long, expires long, writes long, payload string"


def session_lifetimes(writes: DataFrame, ttl_seconds: int, late: str = "10 minutes") -> DataFrame:
    """Finished sessions of streamed writes(session_id, ts, seq, payload): begin, last write, end, writes and last payload.

    A session ends ttl_seconds after its last write, once the watermark has passed that.
    """
    out = _timed(writes, late).groupBy("session_id").transformWithStateInPandas(Lifetimes(ttl_seconds * 1_000_000), LIFETIMES, "append", "EventTime")
    return _told(out, "started", "last_write", "expires")


class Uploads(StatefulProcessor):
    """The last upload of a session answers its questions for `ttl` microseconds; a new one replaces it."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.document = handle.getValueState("document", "at long, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.document.get()) if self.document.exists() else None
        out = []
        for us, seq, upload in _ordered(rows)[["us", "seq", "is_upload"]].itertuples(index=False):
            if upload:
                held = (us, seq)
            else:
                out.append((seq, held[1] if held and us < held[0] + self.ttl else None))
        if held:
            self.document.update(held)
            _rearm(self.handle, held[0] + self.ttl)
        if out:
            seen = pd.array([d for _, d in out], dtype="Int64")
            yield pd.DataFrame({"session_id": key[0], "seq": [s for s, _ in out], "document": seen})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.document.clear()
        yield pd.DataFrame({"session_id": pd.Series(dtype="int64"), "seq": pd.Series(dtype="int64"), "document": pd.array([], dtype="Int64")})

    def close(self) -> None:
        pass


def session_documents(rows: DataFrame, ttl_seconds: int = 7200, late: str = "10 minutes") -> DataFrame:
    """For each question of rows(session_id, ts, seq, is_upload) the seq of the upload it can read, or null."""
    return _timed(rows, late).groupBy("session_id").transformWithStateInPandas(Uploads(ttl_seconds * 1_000_000), "session_id long, seq long, document long", "append", "EventTime")


class Cache(StatefulProcessor):
    """Answers of a user by key. A live one is a hit and is not written over; after `ttl` microseconds the next question stores anew.

    A user's live answers are one value, read and written once a batch: each call of the state store is a message
    between worker and JVM, and costs more than what it carries. A user with a value has one timer, and no other user has.
    """

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stored = handle.getValueState("stored", "asked array<string>, at array<long>")

    def _arm(self, live: dict[str, int]) -> None:
        self.handle.registerTimer((min(live.values()) + self.ttl) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = _ordered(rows)
        held = self.stored.get()
        live: dict[str, int] = dict(zip(held[0], held[1])) if held else {}
        hits, since = [], []
        for us, asked in zip(frame["us"].tolist(), frame["cache_key"].tolist()):
            at = live.get(asked)
            hits.append(at is not None and us <= at + self.ttl)
            if not hits[-1]:
                live[asked] = at = us
            since.append(at)
        self.stored.update((list(live), list(live.values())))
        if not held:
            self._arm(live)
        yield pd.DataFrame({"user_id": key[0], "seq": frame["seq"].to_numpy(), "cache_key": frame["cache_key"].to_numpy(), "hit": hits, "stored_at": since})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, held = expiredTimerInfo.getExpiryTimeInMs() * 1000, self.stored.get()
        left = {asked: at for asked, at in zip(held[0], held[1]) if at + self.ttl >= now} if held else {}
        if left:
            self.stored.update((list(left), list(left.values())))
            self._arm(left)
        else:
            self.stored.clear()
        return iter(())

    def close(self) -> None:
        pass


def cached_answers(asked: DataFrame, ttl_hours: float = 168, late: str = "10 minutes") -> DataFrame:
    """For each question of asked(user_id, ts, seq, cache_key): whether it is a hit, and since when its answer is stored."""
    schema = "user_id long, seq long, cache_key string, hit boolean, stored_at long"
    out = _timed(asked, late).groupBy("user_id").transformWithStateInPandas(Cache(int(ttl_hours * 3_600_000_000)), schema, "append", "EventTime")
    return _told(out, "stored_at")


class Limiter(StatefulProcessor):
    """At most `most` admitted calls in any `span` microseconds; refused calls do not count."""

    def __init__(self, most: int, span: int) -> None:
        self.most, self.span = most, span

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.admitted = handle.getListState("admitted", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [at for (at,) in self.admitted.get()] if self.admitted.exists() else []
        frame = _ordered(rows)
        allowed = []
        for us in frame["us"].tolist():
            held = [at for at in held if at > us - self.span]
            allowed.append(len(held) < self.most)
            if allowed[-1]:
                held.append(us)
        self.admitted.put([(at,) for at in held])
        _rearm(self.handle, held[-1] + self.span)
        yield pd.DataFrame({"user_id": key[0], "seq": frame["seq"].to_numpy(), "allowed": allowed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.admitted.clear()
        yield pd.DataFrame({"user_id": pd.Series(dtype="int64"), "seq": pd.Series(dtype="int64"), "allowed": pd.Series(dtype="bool")})

    def close(self) -> None:
        pass


def limited(calls: DataFrame, most: int = 100, seconds: float = 60.0, late: str = "10 minutes") -> DataFrame:
    """(user_id, seq, allowed) of streamed calls(user_id, ts, seq); a user's state goes once none of their calls counts."""
    limiter = Limiter(most, int(seconds * 1_000_000))
    return _timed(calls, late).groupBy("user_id").transformWithStateInPandas(limiter, "user_id long, seq long, allowed boolean", "append", "EventTime")


class Fold(StatefulProcessor):
    """The last `most` turns of a conversation, long answers cut; each new turn says which one it pushes out."""

    def __init__(self, most: int, longest: int, brief: int) -> None:
        self.most, self.longest, self.brief = most, longest, brief

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn_id long, query string, answer string")
        self.asked = handle.getValueState("asked", "query string, turns long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(t) for t in self.turns.get()] if self.turns.exists() else []
        query, n = tuple(self.asked.get()) if self.asked.exists() else (None, 0)
        out = []
        for role, text in pd.concat(list(rows)).sort_values("turn")[["role", "text"]].itertuples(index=False):
            text = text if isinstance(text, str) else ""
            if role == "user":
                query = text
                continue
            n += 1
            answer = text if len(text) <= self.longest else text[: self.longest].rsplit(" ", 1)[0] + "..."
            held.append((n, query, answer))
            gone = held.pop(0)[0] if len(held) > self.most else None
            out.append((n, query, answer, text if len(text) < self.brief else "", len(held), gone))
        if held:
            self.turns.put(held)
        self.asked.update((query, n))
        if out:
            frame = pd.DataFrame(out, columns=["turn_id", "query", "answer", "summary", "held", "pushed_out"])
            frame["pushed_out"] = frame["pushed_out"].astype("Int64")
            frame.insert(0, "conv_id", key[0])
            yield frame

    def close(self) -> None:
        pass


def folded(turns: DataFrame, most: int = 10, longest: int = 500, brief: int = 150) -> DataFrame:
    """(conv_id, turn_id, query, answer, summary, held, pushed_out) for each answer of streamed turns(conv_id, turn, role, text).

    Turns of a conversation come in order, over all batches. Numbers never repeat.
    """
    schema = "conv_id long, turn_id long, query string, answer string, summary string, held long, pushed_out long"
    return turns.groupBy("conv_id").transformWithStateInPandas(Fold(most, longest, brief), schema, "append", "None")


class Jobs(StatefulProcessor):
    """The states of a job: queued, running, retrying, and at last succeeded, failed or timed_out."""

    def __init__(self, timeout: int, keep: int, attempts: int) -> None:
        self.timeout, self.keep, self.attempts = timeout, keep, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "state string, attempt long, due long")

    def due(self, job: tuple | None, us: int) -> tuple[tuple | None, list[tuple]]:
        """The job after what falls due before us: its deadline, then the end of its keeping."""
        out = []
        if job and job[0] not in FINAL and us > job[2]:
            out.append((job[2], "timed_out", job[1]))
            job = ("timed_out", job[1], job[2] + self.keep)
        if job and job[0] in FINAL and us > job[2]:
            job = None
        return job, out

    def step(self, job: tuple | None, us: int, event: str) -> tuple[tuple | None, list[tuple]]:
        """The job after an event and its transitions (time, state, attempt); events that do not fit the state change nothing."""
        job, out = self.due(job, us)
        state, attempt, until = job or (None, 0, 0)
        if event == "created" and job is None:
            state, until = "queued", us + self.timeout
        elif event == "started" and state in ("queued", "retrying"):
            state, attempt = "running", attempt + 1
        elif event == "failed" and state == "running":
            state = "retrying" if attempt < self.attempts else "failed"
        elif event == "succeeded" and state == "running":
            state = "succeeded"
        else:
            return job, out
        return (state, attempt, us + self.keep if state in FINAL else until), [*out, (us, state, attempt)]

    def _rows(self, key: tuple, out: list[tuple]) -> Iterator[pd.DataFrame]:
        frame = pd.DataFrame(out, columns=["at", "state", "attempt"]).astype({"at": "int64", "state": "object", "attempt": "int64"})
        frame.insert(0, "job_id", pd.Series([key[0]] * len(out), dtype="int64"))
        yield frame

    def _keep(self, job: tuple | None) -> None:
        if job:
            self.job.update(job)
            _rearm(self.handle, job[2])
        else:
            self.job.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        job, told = tuple(self.job.get()) if self.job.exists() else None, []
        for us, event in _ordered(rows)[["us", "event"]].itertuples(index=False):
            job, out = self.step(job, us, event)
            told += out
        self._keep(job)
        yield from self._rows(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        job = tuple(self.job.get()) if self.job.exists() else None
        job, told = self.due(job, timerValues.getCurrentWatermarkInMs() * 1000)
        self._keep(job)
        yield from self._rows(key, told)

    def close(self) -> None:
        pass


FINAL = ("succeeded", "failed", "timed_out")


def job_states(events: DataFrame, timeout_seconds: float = 300, keep_seconds: float = 3600, attempts: int = 3, late: str = "10 minutes") -> DataFrame:
    """(job_id, at, state, attempt): transitions of streamed events(job_id, ts, seq, event), event being created, started, failed or succeeded.

    A job that is not finished timeout_seconds after its creation times out at that
    moment, once the watermark or an event has passed it. A failed attempt is tried
    again up to `attempts` in all. A finished job is known for keep_seconds, during
    which its number cannot be created anew.
    """
    jobs = Jobs(int(timeout_seconds * 1_000_000), int(keep_seconds * 1_000_000), attempts)
    out = _timed(events, late).groupBy("job_id").transformWithStateInPandas(jobs, "job_id long, at long, state string, attempt long", "append", "EventTime")
    return _told(out, "at")
