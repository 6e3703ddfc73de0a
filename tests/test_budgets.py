from __future__ import annotations

import random
from datetime import datetime, timedelta

from lodestar.streaming import budgets as B

SCHEMA = "trace_id string, call_id string, ts timestamp, tokens long, cost double"
START = datetime(2024, 1, 1)


def calls(rng, n=160):
    rows = [(f"t{rng.randrange(8)}", f"c{i}", START + timedelta(seconds=20 * i + rng.randrange(200)), rng.choice([0, 100, 5000, None]), rng.choice([0.0, 0.01, 0.03])) for i in range(n)]
    return rows + [rows[k] for k in range(0, n, 9)]  # some come twice


def plain(rows, budget):
    out = {}
    for trace in {r[0] for r in rows}:
        used, seen = [0, 0, 0.0], set()
        for ts, call, tokens, cost in sorted((r[2], r[1], r[3] or 0, r[4] or 0.0) for r in rows if r[0] == trace):
            if call in seen:
                continue
            seen.add(call)
            refused = budget.refusal(*used)
            out[trace, call] = (ts, *used[:2], round(used[2], 6), refused)
            if not refused:
                used = [used[0] + 1, used[1] + tokens, used[2] + cost]
    return out


def collected(df):
    return {(r["trace_id"], r["call_id"]): (r["ts"], r["used_calls"], r["used_tokens"], round(r["used_cost"], 6), r["refused"]) for r in df.collect()}


def test_windows_equal_a_walk(spark):
    for seed, budget in enumerate([B.Budget(), B.Budget(100, 9000, 9.0), B.Budget(100, 10**9, 0.05), B.Budget(0)]):
        rows = calls(random.Random(seed))
        got = collected(B.checked(spark.createDataFrame(rows, SCHEMA).repartition(4), budget))
        assert got == plain(rows, budget)
    assert B.checked(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_stream_with_late_and_doubled_calls_and_a_restart_equals_the_windows(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng, budget = random.Random(11), B.Budget(6, 12_000, 0.08)
    rows = calls(rng)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][2] + timedelta(seconds=rng.randrange(500)), i))  # out of order, within the watermark
    source, target, marks = (str(tmp_path / x) for x in ("in", "out", "marks"))
    wait = timedelta(minutes=30)
    batches = [[rows[i] for i in order[k : k + 45]] for k in range(0, len(order), 45)]
    end = max(r[2] for r in rows)
    too_late = [("t0", "late", START - wait, 10**6, 9.9)]
    batches += [[("flush", "f1", end + wait, 0, 0.0)], too_late, [("flush", "f2", end + 2 * wait, 0, 0.0)]]

    def run():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        q = B.metered(stream, budget, "10 minutes", idle_ms=10**9).writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(target)
        q.awaitTermination(120)
        assert q.exception() is None
        q.stop()

    for k, batch in enumerate(batches):
        spark.createDataFrame(batch, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        if k == 1:
            run()  # stops here, and starts again from the checkpoint
    run()
    got = collected(spark.read.parquet(target).filter("trace_id != 'flush'"))
    assert got == plain(rows, budget)
