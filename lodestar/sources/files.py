"""File sources: routing, Markdown and JSON Lines, data sets with required shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

CASE_SCHEMA = S.StructType([
    S.StructField("id", S.StringType()), S.StructField("category", S.ArrayType(S.StringType())), S.StructField("ci_core", S.BooleanType()),
    S.StructField("input", S.StructType([S.StructField("query", S.StringType()), S.StructField("turns", S.ArrayType(S.StringType())), S.StructField("item_names", S.ArrayType(S.StringType()))])),
    S.StructField("expected", S.StructType([
        S.StructField("behavior", S.StringType()), S.StructField("must_not_contain", S.ArrayType(S.StringType())), S.StructField("requires_citation", S.BooleanType()),
        S.StructField("retrieval_k", S.IntegerType()), S.StructField("metric_thresholds", S.MapType(S.StringType(), S.DoubleType())),
    ])),
])


def route(files: DataFrame, path: str = "path") -> DataFrame:
    """Which parser takes a file, by its suffix, and the title that its name gives."""
    suffix = F.lower(F.regexp_extract(path, r"\.[^.]+$", 0))
    kind = F.when(suffix == ".pdf", "pdf").when(suffix.isin(".md", ".markdown"), "markdown").otherwise("error")
    return files.withColumn("route", kind).withColumn("title", F.regexp_extract(path, r"([^/]+)\.[^.]+$", 1))


def markdown(spark: SparkSession, path: str) -> DataFrame:
    """Whole Markdown files with their line ends."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def cases(spark: SparkSession, path: str, required: list[str] = ()) -> DataFrame:
    """Evaluation cases from JSON Lines: blank lines are skipped; ids must be unique, input and expected objects, and the categories complete."""
    rows = spark.read.schema(CASE_SCHEMA).option("mode", "FAILFAST").json(path).filter("id is not null or input is not null")
    bad = rows.agg(
        (F.count("*") - F.countDistinct("id")).alias("repeated"), F.count_if(F.col("input").isNull() | F.col("expected").isNull()).alias("incomplete"),
        F.array_except(F.array(*map(F.lit, required)) if required else F.array().cast("array<string>"), F.array_distinct(F.flatten(F.collect_set("category")))).alias("missing"),
    ).first()
    if bad["repeated"] or bad["incomplete"] or bad["missing"]:
        raise ValueError(f"{bad['repeated']} repeated ids, {bad['incomplete']} incomplete cases, missing categories {bad['missing']}")
    return rows


def narrowed(df: DataFrame, wanted: list[str], needed: tuple[str, ...] = ()) -> DataFrame:
    """The wanted columns that exist; the needed ones must."""
    lacking = [c for c in needed if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns {lacking}")
    return df.select(*(c for c in wanted if c in df.columns))
