"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest side that is broadcast, in bytes of its serialised rows; larger ones are joined through a shuffle.
BROADCAST_BYTES = 8 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session names in spark.checkpoint.dir, which driver and executors share.

    Only where that setting is missing (a local session, as in tests) a temporary folder is made.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
    return f"{root.rstrip('/')}/lodestar-{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: later steps survive the loss of an executor and start from the files."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept._kept_at = path
    return kept


def discard(*frames: DataFrame) -> None:
    """Delete tables that `keep` wrote and that no later step reads; a frame of another origin is left alone."""
    for df in frames:
        path = getattr(df, "_kept_at", None)
        if path:
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def with_row_key(df: DataFrame, name: str = "_row") -> DataFrame:
    """`df` with a number of its own for every row: the row's file and its place there, the same at each reading.

    A frame that does not come from files is written first.
    """
    try:
        files = df.select(F.col("_metadata.file_path").alias("_file"))
    except AnalysisException:
        df = keep(df, "rows")
        files = df.select(F.col("_metadata.file_path").alias("_file"))
    paths = sorted(x["_file"] for x in files.distinct().collect())
    known = df.sparkSession.createDataFrame(list(enumerate(paths)), "_number long, _file string")
    rows = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_index"))
    return rows.join(F.broadcast(known), "_file").select(*df.columns, F.shiftleft("_number", 40).bitwiseOR(F.col("_index")).alias(name))


def if_small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """`df` with a broadcast hint if its counted rows, at `row_bytes` each, stay under BROADCAST_BYTES; else `df` as it is."""
    rows = df.count() if rows is None else rows
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df


def pieces(rows: int, size: int) -> int:
    """How many pieces of about `size` rows, at least one."""
    return max(1, -(-rows // size))


def bucket(n: int, *columns: Column | str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column's text, modulo n; null for a null value."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n))
