"""Budgets of a request's model calls, checked before each call: calls, tokens and cost, on a table by windows, on a stream with state.

Events are the calls that a trace wants to make (trace_id, call_id, ts, tokens,
cost). A call is let go while less than the budget has been used by the calls
of its trace that were let go before it, in order of time and id; what it
uses itself may exceed the budget. A refused call uses nothing. A call id that comes twice is one call, at its first time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

CHECKED = "trace_id string, call_id string, ts timestamp, used_calls long, used_tokens long, used_cost double, refused string"


@dataclass(frozen=True)
class Budget:
    """What the calls of one request may use."""

    calls: int = 4
    tokens: int = 12_000
    cost: float = 0.05

    def refusal(self, calls: int, tokens: int, cost: float) -> str | None:
        return "calls" if calls >= self.calls else "tokens" if tokens >= self.tokens else "cost" if cost >= self.cost else None


def checked(calls: DataFrame, budget: Budget = Budget()) -> DataFrame:
    """(trace_id, call_id, ts, used_calls, used_tokens, used_cost, refused) on a table: `refused` names the budget that was used up, null for calls that may go.

    Sums never fall, so the first refusal is final, and the sums before it tell it.
    """
    first = Window.partitionBy("trace_id", "call_id").orderBy("ts")
    one = calls.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    before = Window.partitionBy("trace_id").orderBy("ts", "call_id").rowsBetween(Window.unboundedPreceding, -1)
    total = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    sums = one.withColumn("_t", F.coalesce("tokens", F.lit(0))).withColumn("_c", F.coalesce("cost", F.lit(0.0)))
    sums = sums.withColumn("_goes", (total(F.lit(1)) < budget.calls) & (total(F.col("_t")) < budget.tokens) & (total(F.col("_c")) < budget.cost))
    used = lambda c: total(F.when(F.col("_goes"), c).otherwise(0))
    made = sums.withColumn("used_calls", used(F.lit(1)).cast("long")).withColumn("used_tokens", used(F.col("_t")).cast("long")).withColumn("used_cost", used(F.col("_c")).cast("double"))

    def reason(b: Budget) -> Column:
        return F.when(F.col("used_calls") >= b.calls, "calls").when(F.col("used_tokens") >= b.tokens, "tokens").when(F.col("used_cost") >= b.cost, "cost")

    return made.withColumn("refused", reason(budget)).select("trace_id", "call_id", "ts", "used_calls", "used_tokens", "used_cost", "refused")


class Meter(StatefulProcessor):
    """One trace's sums, the calls that wait for the watermark, and the ids seen.

    Calls are decided when the watermark has passed them, so that what came out
    of order is decided in order; a timer stands at each waiting call. A trace
    that is idle for `idle_ms` of event time after its last call is forgotten.
    """

    def __init__(self, budget: Budget, idle_ms: int):
        self.budget, self.idle_ms = budget, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.used = handle.getValueState("used", "calls long, tokens long, cost double, last long")
        self.waiting = handle.getListState("waiting", "at long, call_id string, tokens long, cost double")
        self.seen = handle.getMapState("seen", "call_id string", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh: dict[str, tuple] = {}
        for frame in rows:
            at = frame["ts"].astype("datetime64[us]").astype("int64")
            for call in zip(at, frame["call_id"], frame["tokens"].fillna(0), frame["cost"].fillna(0.0), strict=True):
                if call[1] not in fresh or call[0] < fresh[call[1]][0]:
                    fresh[call[1]] = (int(call[0]), call[1], int(call[2]), float(call[3]))
        for name, call in fresh.items():
            if not self.seen.containsKey((name,)):
                self.seen.updateValue((name,), (call[0],))
                self.waiting.appendValue(call)
                self.handle.registerTimer(call[0] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(c) for c in self.waiting.get()) if self.waiting.exists() else []
        calls, tokens, cost, last = self.used.get() if self.used.exists() else (0, 0, 0.0, 0)
        out = []
        due = [c for c in held if c[0] // 1000 < passed]
        for at, name, more_tokens, more_cost in due:
            refused = self.budget.refusal(calls, tokens, cost)
            out.append((key[0], name, datetime.fromtimestamp(at / 1e6, UTC).replace(tzinfo=None), calls, tokens, cost, refused))
            if refused is None:
                calls, tokens, cost = calls + 1, tokens + more_tokens, cost + more_cost
            last = max(last, at // 1000)
        if due:
            self.used.update((calls, tokens, cost, last))
            rest = held[len(due) :]
            self.waiting.put(rest) if rest else self.waiting.clear()
            self.handle.registerTimer(last + self.idle_ms)
        elif not held and last + self.idle_ms <= passed:
            for state in (self.used, self.waiting, self.seen):
                state.clear()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CHECKED.split(", ")])

    def close(self) -> None:
        pass


def metered(calls: DataFrame, budget: Budget = Budget(), late: str = "10 minutes", idle_ms: int = 3_600_000) -> DataFrame:
    """`checked` on a stream of calls (trace_id string, call_id string, ts, tokens, cost), each row when no earlier call can come any more.

    Calls later than `late` are dropped by the watermark. State lives in the
    state store (RocksDB, which the session must name) and survives a restart from the checkpoint.
    """
    marked = calls.select("trace_id", "call_id", "ts", F.col("tokens").cast("long").alias("tokens"), F.col("cost").cast("double").alias("cost")).withWatermark("ts", late)
    return marked.groupBy("trace_id").transformWithStateInPandas(Meter(budget, idle_ms), CHECKED, "append", "EventTime")
