"""Search over the leaves of a page index: words, titles, identifiers and the whole question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .fusion import ranked
from .sized import by_blocks, written

#: Weights of body, title, identifiers and phrase, the usual length of a leaf in tokens, and hits a question.
BODY, TITLE, NAMED, PHRASE, USUAL, TOP = 0.35, 0.12, 0.30, 0.20, 180.0, 8
TOKEN = r"[a-z0-9][a-z0-9_./:-]*"


def tokens(text: Column) -> Column:
    """Latin words and numbers, then CJK characters and pairs of neighbours, all in lower case; repeated ones count."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    cjk = F.array_join(F.regexp_extract_all(low, F.lit(f"({T.CJK})"), 1), "")
    ones = F.when(cjk != "", F.split(cjk, "")).otherwise(F.array().cast("array<string>"))
    n = F.length(cjk)
    twos = F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(cjk, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.regexp_extract_all(low, F.lit(f"({TOKEN})"), 1), ones, twos)


def _marked(kind: str, values: Column) -> Column:
    return F.transform(values, lambda w: F.struct(F.lit(kind).alias("kind"), w.alias("w")))


def questions_of(questions: DataFrame) -> DataFrame:
    """(query_id, question, tokens, m, k, asked, sure): questions with a token.

    `asked` are their marked words with how often each counts. `sure` are words
    that every text has which holds the whole question: all its tokens but the
    first and the last, which a text may continue, and all CJK characters.
    """
    q = questions.select("query_id", F.trim("question").alias("question"), tokens(F.col("question")).alias("_t"), T.identifiers(F.col("question")).alias("_i")).filter(F.size("_t") > 0)
    low = F.lower("question")
    latin = F.regexp_extract_all(low, F.lit(f"({TOKEN})"), 1)
    inner = F.when(F.size(latin) > 2, F.slice(latin, F.lit(2), F.greatest(F.size(latin) - 2, F.lit(0)))).otherwise(F.array().cast("array<string>"))
    sure = F.array_distinct(F.concat(inner, F.filter("_t", lambda w: (F.length(w) == 1) & w.rlike(T.CJK))))
    asked = F.concat(_marked("body", F.col("_t")), _marked("title", F.col("_t")), _marked("named", F.col("_i")))
    return q.select("query_id", "question", F.size("_t").alias("m"), F.size("_i").alias("k"), asked.alias("asked"), sure.alias("sure"))


def postings(leaves: DataFrame) -> DataFrame:
    """(kind, w, node_id, n): which leaves (node_id, title, text) have a word in their body, title or identifiers; `n` is the body's length in tokens."""
    full = leaves.filter("text != ''").select("node_id", "title", "text", tokens(F.col("text")).alias("_b"))
    words = F.concat(_marked("body", F.array_distinct("_b")), _marked("title", F.array_distinct(tokens(F.col("title")))), _marked("named", T.identifiers(F.concat_ws(" ", "text", "title"))))
    return full.select("node_id", F.size("_b").alias("n"), F.explode(words).alias("x")).select("x.kind", "x.w", "node_id", "n")


def _phrases(q: DataFrame, hits: DataFrame, leaves: DataFrame) -> DataFrame:
    """(query_id, node_id, n): leaves whose text or title holds a whole question; `hits` are the postings of the questions' words.

    Candidates are the leaves that have the rarest of its sure words, which are
    then read and compared. Questions without a sure word, of one or two Latin
    tokens, can stand inside longer words: those alone are looked for in all leaves, in blocks.
    """
    sure = q.select("query_id", "question", F.explode(F.flatten(F.array(_marked("body", F.col("sure")), _marked("title", F.col("sure"))))).alias("x")).select("query_id", "question", "x.kind", "x.w")
    counts = hits.groupBy("kind", "w").agg(F.count("*").alias("df"))
    rare = ranked(sure.join(counts, ["kind", "w"]), ["query_id", "kind"], [F.col("df"), F.col("w")], 1)
    near = by_blocks(rare.select("query_id", "question", "kind", "w"), 1024, ["query_id"], lambda block: hits.join(block, ["kind", "w"]).select("query_id", "question", "kind", "node_id", "n"))
    own = leaves.filter("text != ''").select("node_id", "title", "text")
    shown = F.when(F.col("kind") == "body", F.col("text")).otherwise(F.col("title"))
    found = near.join(own, "node_id").filter(F.contains(F.lower(shown), F.lower("question"))).select("query_id", "node_id", "n")
    short = q.filter(F.size("sure") == 0).select("query_id", "question")
    whole = F.contains(F.lower("text"), F.lower("question")) | F.contains(F.lower("title"), F.lower("question"))
    return found.unionByName(by_blocks(short, 1024, ["query_id"], lambda block: own.join(block, whole).select("query_id", "node_id", F.size(tokens(F.col("text"))).alias("n")))).distinct()


def _scored(q: DataFrame, held: DataFrame, leaves: DataFrame, top: int) -> DataFrame:
    asked = q.select("query_id", F.explode("asked").alias("x")).groupBy("query_id", F.col("x.kind").alias("kind"), F.col("x.w").alias("w")).agg(F.count("*").alias("hits"))
    # The postings of the words that are asked for are written once: the leaves' words are made, or read, in one pass.
    hits = written(by_blocks(asked.select("kind", "w").distinct(), 64, ["kind", "w"], lambda block: held.join(block, ["kind", "w"]).select("kind", "w", "node_id", "n")), "hits")
    met = by_blocks(asked, 64, ["query_id"], lambda block: hits.join(block, ["kind", "w"]).select("query_id", "node_id", "n", "kind", "hits"))
    said = _phrases(q, hits, leaves).select("query_id", "node_id", "n", F.lit("phrase").alias("kind"), F.lit(1).cast("long").alias("hits"))
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("hits"))), F.lit(0))
    sums = met.unionByName(said).groupBy("query_id", "node_id", "n").agg(*(part(k).alias(k) for k in ("body", "title", "named", "phrase"))).join(q.select("query_id", "m", "k"), "query_id")
    most = lambda c, n: F.least(F.lit(1.0), F.col(c) / F.greatest(F.lit(1), F.col(n)))
    damped = 0.75 + 0.25 * F.least(F.lit(1.0), F.lit(USUAL) / F.greatest(F.lit(1), F.col("n")))
    score = BODY * (F.col("body") / F.col("m")) * damped + TITLE * most("title", "m") + NAMED * most("named", "k") + F.when(F.col("phrase") > 0, PHRASE).otherwise(0.0)
    scored = sums.select("query_id", "node_id", F.round(F.least(F.lit(1.0), score) + 1e-9, 6).alias("score"))
    return ranked(scored, ["query_id"], [F.desc("score"), F.col("node_id")], top)


def search(questions: DataFrame, leaves: DataFrame, top: int = TOP) -> DataFrame:
    """(query_id, node_id, score, rank): the best leaves (node_id, title, text) of each question (query_id, question).

    Questions are the small side: in blocks of counted size they meet the
    leaves' words; only pairs with a hit are aggregated. A question without a
    token finds nothing; leaves without text are not searched.
    """
    return _scored(questions_of(questions), postings(leaves), leaves, top)


#: Buckets of a stored index, by the hash of kind and word for postings, by that of the node for leaves.
BUCKETS, VERSION = 256, "1"


def _bucket(buckets: int | Column, *columns: str) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


def store(leaves: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the index of leaves (node_id, title, text) to a new folder: postings and leaves by bucket, and what they were made with.

    The manifest is written last, so that an index without one is not whole.
    """
    held = postings(leaves).withColumn("bucket", _bucket(buckets, "kind", "w"))
    held.repartition("bucket").sortWithinPartitions("kind", "w").write.partitionBy("bucket").parquet(f"{path}/postings")
    kept = leaves.filter("text != ''").select("node_id", "title", "text", F.size(tokens(F.col("text"))).alias("n")).withColumn("bucket", _bucket(buckets, "node_id"))
    kept.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/leaves")
    spark = leaves.sparkSession
    spark.range(1).select(F.lit(VERSION).alias("version"), F.lit(buckets).alias("buckets"), F.lit(dict(leaves.dtypes)["node_id"]).alias("key")).write.json(f"{path}/manifest")


def stored_postings(q: DataFrame, path: str, buckets: int, kind: str) -> DataFrame:
    """Of a stored index, the postings in the buckets of the words of `questions_of`; at most `buckets` numbers, which the plan names, so that no other folder is opened."""
    spark = q.sparkSession
    wanted = q.select(F.explode("asked").alias("x")).select(_bucket(buckets, "x.kind", "x.w")).distinct()
    numbers = sorted(r[0] for r in wanted.collect())
    held = spark.read.schema(f"kind string, w string, node_id {kind}, n int, bucket int").parquet(f"{path}/postings")
    return held.filter(F.col("bucket").isin(numbers) if numbers else F.lit(False)).drop("bucket")


def search_stored(questions: DataFrame, path: str, top: int = TOP) -> DataFrame:
    """As `search`, over a stored index: of the postings, only the buckets of the questions' words are read, and leaves only where a phrase may stand."""
    spark = questions.sparkSession
    made = spark.read.schema("version string, buckets int, key string").json(f"{path}/manifest").first()
    if made is None or made["version"] != VERSION:
        raise ValueError(f"{path} holds no whole index of version {VERSION}")
    q = questions_of(questions)
    kept = spark.read.schema(f"node_id {made['key']}, title string, text string, n int, bucket int").parquet(f"{path}/leaves").drop("bucket")
    return _scored(q, stored_postings(q, path, made["buckets"], made["key"]), kept, top)


def indexes(files: DataFrame, path: str = "path") -> DataFrame:
    """(path) of the whole indexes in a list of files: folders whose manifest is complete."""
    return files.select(F.regexp_extract(path, r"^(.*)/manifest/_SUCCESS$", 1).alias("path")).filter("path != ''").distinct()
