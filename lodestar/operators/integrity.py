"""Checks of keys and references, and tables that are replaced as a whole."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose reference names no parent."""
    return child.select(F.col(column).alias("_k")).join(parent.select(F.col(key).alias("_k")), "_k", "left_anti")


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def report(rules: list[tuple[str, DataFrame]]) -> DataFrame:
    """(rule, violations): one row per rule."""
    return reduce(DataFrame.unionByName, (rows.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, rows in rules))


def require_none(found: DataFrame) -> None:
    bad = found.filter("violations > 0").collect()
    if bad:
        raise ValueError("; ".join(f"{r['rule']}: {r['violations']}" for r in bad))


def overwrite_keys(spark: SparkSession, incoming: DataFrame, path: str, partition: str) -> None:
    """Delete-by-key then insert: the partitions of the incoming keys are replaced in one commit, others stay."""
    incoming.write.option("partitionOverwriteMode", "dynamic").partitionBy(partition).mode("overwrite").parquet(path)


def switched(config: DataFrame, target: dict[str, str], allowed: set[str]) -> DataFrame:
    """A (key, value) table with the named keys repointed; unknown keys or unsafe values are refused, the rest stays."""
    import re

    if set(target) - allowed:
        raise ValueError(f"keys that may not be switched: {sorted(set(target) - allowed)}")
    if bad := [v for v in target.values() if not re.fullmatch(r"[A-Za-z0-9_.-]+", v)]:
        raise ValueError(f"unsafe values: {bad}")
    value = F.col("value")
    for k, v in target.items():
        value = F.when(F.col("key") == k, F.lit(v)).otherwise(value)
    return config.withColumn("value", value)
