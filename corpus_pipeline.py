"""A corpus pipeline: toxicity, language, near duplicates, benchmark passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor
kept; what it returns is written as Parquet and read again as the next stage's
docs. All but the last stage return the columns of documents.

Defined cases: a null text is kept by the first four stages if its language
stage does not reject it; as it has no letter, it is rejected there. A
document with a null id is judged like any other: the stages reject rows, not
ids, so rows that share an id are judged each by its own text. Of linked
documents one row stays. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm import decontaminate, jaccard_join, language_id, packing, toxicity
from lodestar.llm.common import keep, with_row_key
from lodestar.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The least share of its judgement that the byte network must give to one language; below it, the text is in none that it knows.
LEAST_SCORE = 1 / 3


#: What a row takes along besides its id while it is judged.
CARRIED = tuple(COLUMNS[1:])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the subword model takes to be toxic go."""
    verdict = toxicity.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=CARRIED)
    return verdict.filter("predicted = 0").select(*COLUMNS)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter, or of which the network gives no language LEAST_SCORE; all go if there was nothing to learn from."""
    verdict = language_id.identify(docs, carry=CARRIED)
    return verdict.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays: of those with the smallest id, null last, the first."""
    rows = with_row_key(docs.select(*COLUMNS))
    groups = keep(jaccard_join.join(rows, key="_row").filter("n_shingles > 0").select("_row", "component_id"), "groups")
    shared = keep(groups.filter("component_id < _row").select("component_id").distinct(), "shared")
    members = groups.join(shared, "component_id", "left_semi").join(rows.select("_row", "doc_id"), "_row")
    order = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_row")
    first = members.groupBy("component_id").agg(F.min(order).getField("_row").alias("_first"))
    bad = keep(members.join(first, "component_id").filter("_row != _first").select(F.col("_row").alias("_bad")), "rejected")
    return rows.join(bad, F.col("_row") == F.col("_bad"), "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy of a benchmark item go."""
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rest is encoded and packed into sequences of equal cost."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unknown_language),
    ("jaccard_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Trained models, an alignment and a tokenizer take part, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
