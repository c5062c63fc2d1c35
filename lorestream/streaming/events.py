"""Structured Streaming: windowed metrics with late rows dropped, an exact sliding rate limit, conversation state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """Count and mean value by window and event_type; rows later than the watermark are dropped."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", every), "event_type")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
        .select(F.col("window.start").alias("start"), "event_type", "n", "mean")
    )


def session_windows(events: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    """Events by user and session."""
    per = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return per.select(F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "user_id", "n")


def admit(times: list[float], held: list[float], most: int, seconds: float) -> tuple[list[bool], list[float]]:
    """Verdict on each time, in order, and the admitted ones still within the span: refused calls do not count."""
    out = []
    for t in times:
        held = [h for h in held if h > t - seconds]
        out.append(len(held) < most)
        if out[-1]:
            held.append(t)
    return out, held


def rate_limited(events: DataFrame, most: int = 100, seconds: float = 60.0) -> DataFrame:
    """(user_id, event_id, allowed) of streamed events(event_id, ts, user_id). State: at most `most` times a user."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        allowed, held = admit((rows["ts"].astype("int64") / 1e9).tolist() if str(rows["ts"].dtype) == "datetime64[ns]" else [t.timestamp() for t in rows["ts"]], held, most, seconds)
        state.update((held,))
        yield pd.DataFrame({"user_id": key[0], "event_id": rows["event_id"].to_numpy(), "allowed": allowed})

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, allowed boolean", "held array<double>", "append", GroupStateTimeout.NoTimeout)
