"""Request limits and traces: on a table by windows, on a stream with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def within_rate(requests: DataFrame, key: str, limit: int, seconds: int = 60, ts: str = "ts") -> DataFrame:
    """Requests with the number of their key's requests in the last `seconds`, itself included, and whether that stays within the limit."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    recent = F.count("*").over(Window.partitionBy(key).orderBy(at).rangeBetween(-seconds * 1_000_000 + 1, 0))
    return requests.withColumn("recent", recent).withColumn("allowed", F.col("recent") <= limit)


def admitted(requests: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """(key, ts, allowed) on a stream (key string, ts timestamp): a request is let in if fewer than `limit` were within the last `seconds`.

    State is the times of the requests let in within the window, `limit` at
    most; it is dropped when a key is idle for longer than the window.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        times = pd.concat(list(batches))["ts"].sort_values()
        fine = []
        for t in times:
            at = t.timestamp()
            held = [h for h in held if h > at - seconds]
            fine.append(len(held) < limit)
            held += [at] if fine[-1] else []
        state.update((held,))
        state.setTimeoutDuration(seconds * 1000)
        yield pd.DataFrame({"key": key[0], "ts": times.to_numpy(), "allowed": fine})

    return requests.groupBy("key").applyInPandasWithState(update, "key string, ts timestamp, allowed boolean", "held array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def traces(events: DataFrame, key: str = "trace_id") -> DataFrame:
    """(key, calls, tokens, complete) from events (key, kind, tokens) of kind begin, call and finish: a trace that was begun and finished is complete; calls without a beginning don't count."""
    per = events.groupBy(key).agg(
        F.count_if(F.col("kind") == "begin").alias("_b"), F.count_if(F.col("kind") == "finish").alias("_f"), F.count_if(F.col("kind") == "call").alias("calls"), F.coalesce(F.sum(F.when(F.col("kind") == "call", F.col("tokens"))), F.lit(0)).alias("tokens"),
    )
    return per.filter("_b > 0").select(key, "calls", "tokens", (F.col("_f") > 0).alias("complete"))
