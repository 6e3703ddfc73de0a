"""Small sides of a join: broadcast only where their counted size allows it, in blocks beyond; intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest side that is broadcast, in bytes of its rows.
BROADCAST_BYTES = 8 << 20
#: About how many bytes of text, or how many rows of short columns, a task is dealt.
TASK_BYTES, TASK_ROWS = 16 << 20, 1 << 20


def if_small(rows: DataFrame, row_bytes: int) -> DataFrame:
    """The rows with a broadcast hint if, counted, they stay under BROADCAST_BYTES; else as they are."""
    return F.broadcast(rows) if rows.count() * row_bytes <= BROADCAST_BYTES else rows


def by_blocks(rows: DataFrame, row_bytes: int, key: list[str], each: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`each` of blocks of the rows, dealt by the key's hash, that are small enough to be broadcast; one block for most."""
    blocks = max(1, -(-rows.count() * row_bytes // BROADCAST_BYTES))
    if blocks == 1:
        return each(F.broadcast(rows))
    part = F.pmod(F.xxhash64(*key), F.lit(blocks))
    return reduce(DataFrame.unionByName, (each(F.broadcast(rows.filter(part == b))) for b in range(blocks)))


def dealt(rows: DataFrame, key: str, text: str | None = None, most: int | None = None) -> DataFrame:
    """The rows dealt by `key` so that a partition holds about `most` bytes of `text`, or without a text about so many rows: what a task sorts does not grow with the table.

    What follows by the key stays in these partitions. There are at least as many as a shuffle has.
    """
    size, most = (F.count("*"), most or TASK_ROWS) if text is None else (F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), most or TASK_BYTES)
    parts = -(-rows.agg(size).first()[0] // most)
    return rows.repartition(max(parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session names in spark.checkpoint.dir; a temporary one only where a local session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/lodestar-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` from a table in the shared folder: what follows starts there, however often it is read and whatever executors are lost."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
