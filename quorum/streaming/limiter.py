"""The rate limiter over a stream, in event time: a key's waiting requests and accepted times are its state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_rate_limit(requests: DataFrame, key: str, n: int, window: float, late: str = "10 seconds") -> DataFrame:
    """Requests (key, t as seconds, event_id) with ``accepted``: what the batch operator says of the same requests.

    All is in event time. A request waits in its key's state until the watermark (``late`` behind the latest time of any key) has passed
    it, as until then an earlier one may come; then all that wait are decided in order of time and id. So neither a
    stalled source nor requests that come out of order change a decision; what comes later than ``late`` is dropped by the engine.
    A key's state holds its waiting requests and at most n accepted times, and ends once the watermark is a window past them.
    """
    from pyspark.sql import functions as F

    def fold(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, ids, held = (list(x) for x in state.get) if state.exists else ([], [], [])
        if not state.hasTimedOut:
            for part in parts:
                times += part["t"].tolist()
                ids += part["event_id"].tolist()
        mark = state.getCurrentWatermarkMs()
        waiting = sorted(zip(times, ids, strict=True))
        due = [x for x in waiting if x[0] * 1000 <= mark]
        waiting, accepted = waiting[len(due) :], []
        for t, _ in due:
            held = [h for h in held if t - h <= window]
            accepted.append(len(held) < n)
            if accepted[-1]:
                held.append(t)
        if not waiting and all((h + window) * 1000 < mark for h in held):
            state.remove()
        else:
            state.update(([t for t, _ in waiting], [i for _, i in waiting], held))
            ahead = waiting[0][0] if waiting else max(held) + window
            state.setTimeoutTimestamp(max(int(ahead * 1000) + 1, mark + 1))
        if due:
            yield pd.DataFrame({key: group[0], "event_id": [i for _, i in due], "accepted": accepted})

    kind = requests.schema[key].dataType.simpleString()
    timed = requests.select(key, F.col("t").cast("double").alias("t"), "event_id", F.timestamp_seconds(F.col("t")).alias("at")).withWatermark("at", late)
    held = "times array<double>, ids array<bigint>, held array<double>"
    return timed.groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, event_id long, accepted boolean", held, "append", GroupStateTimeout.EventTimeTimeout)


def stream_event_counts(events: DataFrame, late: str = "10 minutes", width: str = "6 hours") -> DataFrame:
    """Counts and sums by window and type; windows are emitted once the watermark has passed them."""
    from pyspark.sql import functions as F

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
