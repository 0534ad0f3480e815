"""The same operators on streams: watermarks for lateness, state only where a fold needs it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def buckets(events: DataFrame, size: str = "100 milliseconds", late: str = "200 milliseconds", key: str = "source") -> DataFrame:
    """(key, start, n): tumbling event-time buckets; what is later than the rollback window is dropped."""
    got = events.withWatermark("ts", late).groupBy(F.window("ts", size), key).agg(F.count("*").alias("n"))
    return got.select(key, F.col("window.start").alias("start"), "n")


def once(events: DataFrame, token: list[str], late: str) -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(token)


def rate(events: DataFrame, window: str, slide: str, late: str, key: str = "source") -> DataFrame:
    got = events.withWatermark("ts", late).groupBy(F.window("ts", window, slide), key).agg(F.count("*").alias("n"))
    return got.select(key, F.col("window.end").alias("end"), "n")


def causal(events: DataFrame) -> DataFrame:
    """(source, id, clock) accepted by the causal filter; the state is one number a source. Within a micro-batch events
    are taken in order of id."""

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("id")
        seen = state.get[0] if state.exists else -(2**62)
        before = rows["clock"].cummax().shift(1).fillna(-(2**62)).clip(lower=seen)
        kept = rows[rows["clock"] >= before]
        state.update((int(max(seen, rows["clock"].max())),))
        yield kept[["source", "id", "clock"]]

    return events.select("source", "id", "clock").groupBy("source").applyInPandasWithState(step, "source string, id long, clock long", "seen long", "append", GroupStateTimeout.NoTimeout)


def density_states(counts: DataFrame, split: float, merge: float) -> DataFrame:
    """(region, seq, n, state): hysteresis over arriving counts; the state is its name."""

    def move(state: str, n: int) -> str:
        if state == "NEEDS_SPLIT" and n >= 0.9 * split or state == "NEEDS_MERGE" and n <= 1.1 * merge:
            return state
        return "NEEDS_SPLIT" if n > split else "APPROACHING_SPLIT" if n > 0.9 * split else "NEEDS_MERGE" if n < merge else "APPROACHING_MERGE" if n < 1.1 * merge else "NORMAL"

    def step(key, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state = held.get[0] if held.exists else "NORMAL"
        rows = pd.concat(list(parts)).sort_values("seq")
        out = []
        for seq, n in zip(rows["seq"], rows["n"], strict=True):
            state = move(state, n)
            out.append((key[0], seq, n, state))
        held.update((state,))
        yield pd.DataFrame(out, columns=["region", "seq", "n", "state"])

    return counts.select("region", "seq", "n").groupBy("region").applyInPandasWithState(step, "region string, seq long, n long, state string", "state string", "append", GroupStateTimeout.NoTimeout)


def live_ghosts(updates: DataFrame, ttl_ms: int = 500) -> DataFrame:
    """(id, state): created or active at an update, expired when the watermark has passed the last one by ttl_ms.

    updates: id, ts (a timestamp with a watermark)."""

    def step(key, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            yield pd.DataFrame({"id": [key[0]], "state": ["expired"]})
            return
        n, last = held.get if held.exists else (0, 0)
        for part in parts:
            n += len(part)
            last = max(last, int(part["ts"].max().timestamp() * 1000))
        held.update((n, last))
        held.setTimeoutTimestamp(max(last + ttl_ms, held.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": [key[0]], "state": ["active" if n > 1 else "created"]})

    return updates.groupBy("id").applyInPandasWithState(step, "id long, state string", "n long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def append_log(events: DataFrame, path: str, checkpoint: str):
    """Write-ahead log: a streaming query that appends events as JSON, exactly once; restart it to recover."""
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
