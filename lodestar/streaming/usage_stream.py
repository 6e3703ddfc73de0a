"""Usage of model calls as a stream: windowed sums with late data, and per-trace budgets with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(calls: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, operation, calls, tokens): works on a stream as on a table; on a stream, windows close once the watermark has passed them."""
    marked = calls.withWatermark("ts", late) if calls.isStreaming else calls
    out = marked.groupBy(F.window("ts", length).alias("w"), "operation").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
    return out.select(F.col("w.start").alias("start"), "operation", "calls", "tokens")


def over_budget(calls: DataFrame, budget: int) -> DataFrame:
    """(trace_id, tokens, exceeded): running totals per trace; state is one number a trace and is dropped after an idle hour."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total = (state.get[0] if state.exists else 0) + sum(int(b["tokens"].sum()) for b in batches)
        state.update((total,))
        state.setTimeoutDuration(3_600_000)
        yield pd.DataFrame({"trace_id": [key[0]], "tokens": [total], "exceeded": [total > budget]})

    return calls.groupBy("trace_id").applyInPandasWithState(update, "trace_id long, tokens long, exceeded boolean", "total long", "update", GroupStateTimeout.ProcessingTimeTimeout)
