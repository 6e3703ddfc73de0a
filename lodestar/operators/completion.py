"""Completion of answers by constraints of the best evidence that they leave out, and what of an answer its sources bear."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import phrases as P
from ..functions import text as T
from ..functions import unicode as U
from . import evidence as E

# The mark before an answer's images, and marks that end a claim.
IMAGES = "【图片】"
ENDS = "。！？；"
#: At most so many constraints are added; this share of a constraint's terms counts as said.
MOST, COVERAGE = 4, 0.6


def candidates(content: Column, modes: Column) -> Column:
    """Constraints of a text that matter to a question; those of a question about bounds alone must bound a number."""
    found = P.constraints(F.coalesce(content, F.lit("")))
    bounded = F.array_contains(modes, "boundary") & ~F.arrays_overlap(modes, F.array(F.lit("purpose"), F.lit("safety")))
    return F.when(bounded, P.numeric_boundaries(found)).otherwise(found)


def _marks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({P.CONSTRAINT})"), 1)


def covered(candidate: Column, text: Column, least: float = COVERAGE) -> Column:
    """Whether a text already says a constraint, both in semantic form.

    One with numbers: all of them, and a term. One without terms: word for
    word. Any other: enough of its terms, or a common marker and two terms.
    """
    numbers, terms = T.numbers(candidate), T.terms(candidate)
    shared = F.size(F.array_intersect(terms, T.terms(text)))
    marked = F.arrays_overlap(_marks(candidate), _marks(text))
    enough = (shared >= F.lit(max(0.0, min(1.0, least))) * F.size(terms)) | (marked & (shared >= 2))
    numbered = (F.size(F.array_except(numbers, T.numbers(text))) == 0) & (shared > 0)
    return F.when(F.size(numbers) > 0, numbered).when(F.size(terms) == 0, F.contains(text, candidate)).otherwise(enough)


def completed(rows: DataFrame, most: int = MOST, least: float = COVERAGE, answer: str = "answer", content: str = "content", query: str = "query") -> DataFrame:
    """Rows with `modes`, `candidates`, `appended` and `completed`.

    `content` is that of the best evidence, null if there is none. Candidates
    are taken in order, and one counts only if neither the answer nor what was
    added before covers it; the fold ends at `most`. What is added stands
    before the answer's images and cites the first source.
    """
    body = F.get(F.split(F.coalesce(answer, F.lit("")), IMAGES, 2), F.lit(0))
    images = F.substr(F.coalesce(answer, F.lit("")), F.length(body) + 1)
    made = rows.withColumn("modes", P.modes(F.coalesce(query, F.lit("")))).withColumn("_body", body).withColumn("_images", F.when(images != "", F.concat(F.lit("\n"), images)).otherwise(""))
    fitting = F.when((F.size("modes") > 0) & F.col(content).isNotNull(), candidates(F.col(content), F.col("modes")))
    made = made.withColumn("candidates", F.coalesce(fitting, F.array().cast("array<string>")))
    made = made.withColumn("_forms", U.folded_each(F.col("candidates"))).withColumn("_form", U.semantic_form(F.col("_body")))
    start = F.struct(F.col("_form").alias("text"), F.array().cast("array<string>").alias("added"))

    def step(s: Column, x: Column) -> Column:
        adds = (F.size(s["added"]) < most) & ~covered(x["_forms"], s["text"], least)
        return F.struct(F.when(adds, F.concat(s["text"], x["_forms"])).otherwise(s["text"]).alias("text"), F.when(adds, F.array_append(s["added"], x["candidates"])).otherwise(s["added"]).alias("added"))

    made = made.withColumn("appended", F.aggregate(F.arrays_zip("_forms", "candidates"), start, step, lambda s: s["added"]))
    bare = F.regexp_replace("_body", r"(?U)\s+$", "")
    ended = F.when((bare == "") | bare.rlike(f"[{ENDS}]$"), bare).otherwise(F.concat(bare, F.lit("。")))
    claims = F.transform("appended", lambda c: F.concat(F.rtrim(c, F.lit(ENDS)), F.lit("[1]。")))
    said = F.concat(F.array_join(F.concat(F.filter(F.array(ended), lambda x: x != ""), claims), "\n"), F.col("_images"))
    return made.withColumn("completed", F.when(F.size("appended") > 0, said).otherwise(F.coalesce(answer, F.lit("")))).drop("_body", "_images", "_forms", "_form")


def cited_facts(answers: DataFrame, facts: DataFrame, sources: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, fact, present, cited, sentence, rank): which facts an answer states, and where one stands with a source that bears it.

    Answers (key, answer); facts (key, fact, alternatives, titles); sources (key,
    rank, title, parent_title, content, reviewed): `reviewed` says whether a
    source is one that the case expects, null where the case expects none.

    A fact, its sentence and a source meet by position: a citation belongs to
    the sentence that it stands in, or right behind, and names a source by
    rank. The source bears the fact if its content supports the sentence, or
    if it is reviewed (or none is expected) and has one of the fact's titles
    (or the fact names none). `sentence` and `rank` are of the first such place.
    """
    joined = F.regexp_replace(F.coalesce("answer", F.lit("")), r"[。！？]\s*(?=\[\d+\])", "")
    stated = answers.select(key, U.fact_form(F.coalesce("answer", F.lit(""))).alias("_whole"))
    sentence = answers.select(key, F.posexplode(F.split(joined, r"[。！？\n]")).alias("sentence", "_s")).withColumn("_form", U.fact_form(F.col("_s")))
    said = facts.select(key, "fact", "titles", F.explode(F.filter(F.coalesce("alternatives", F.array().cast("array<string>")), lambda x: x != "")).alias("_a")).withColumn("_a", U.fact_form(F.col("_a")))
    present = said.join(stated, key).groupBy(key, "fact").agg(F.max(F.contains("_whole", F.col("_a"))).alias("present"))
    held = said.join(sentence, key).filter(F.contains("_form", F.col("_a"))).select(key, "fact", "titles", "sentence", "_s").distinct()
    places = held.withColumn("rank", F.explode(F.array_distinct(T.citations(F.col("_s")))))
    bare = T.without_citations(F.col("_s"))
    s = sources.select(key, F.col("rank").cast("int").alias("rank"), F.array(P.canonical_title(F.col("title")), P.canonical_title(F.col("parent_title"))).alias("_titles"), F.coalesce("content", F.lit("")).alias("_c"), "reviewed")
    met = places.join(s, [key, "rank"])
    grounded = F.coalesce(E.supports(bare, T.terms(bare), T.numbers(bare), F.col("_c"), T.terms(F.col("_c")), T.numbers(F.col("_c"))), F.lit(False))
    named = F.transform(F.filter(F.coalesce("titles", F.array().cast("array<string>")), lambda x: x != ""), P.canonical_title)
    bears = grounded | (F.coalesce("reviewed", F.lit(True)) & ((F.size(named) == 0) | F.arrays_overlap(named, F.col("_titles"))))
    first = met.filter(bears).groupBy(key, "fact").agg(F.min(F.struct("sentence", "rank")).alias("_f"))
    out = facts.select(key, "fact").join(present, [key, "fact"], "left").join(first, [key, "fact"], "left")
    return out.select(key, "fact", F.coalesce("present", F.lit(False)).alias("present"), F.col("_f").isNotNull().alias("cited"), F.col("_f.sentence").cast("long").alias("sentence"), F.col("_f.rank").cast("long").alias("rank"))


def answer_images(answers: DataFrame, sources: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, position, url): images that an answer shows and a source that it cites has, in the answer's order, each once; position counts all it shows.

    Answers (key, answer), sources (key, rank, image_urls). Images stand behind the mark IMAGES.
    """
    parts = F.split(F.coalesce("answer", F.lit("")), IMAGES, 2)
    urls = F.regexp_extract_all(F.coalesce(F.get(parts, F.lit(1)), F.lit("")), F.lit(r"(https?://[^\s<>]+)"), 1)
    shown = F.array_distinct(F.transform(urls, lambda u: F.rtrim(u, F.lit("，。);）]"))))
    proposed = answers.select(key, F.posexplode(shown).alias("position", "url"))
    cites = answers.select(key, F.explode(F.array_distinct(T.citations(F.col("answer")))).alias("rank"))
    held = sources.select(key, F.col("rank").cast("int").alias("rank"), F.explode("image_urls").alias("url"))
    allowed = cites.join(held, [key, "rank"]).select(key, "url").distinct()
    return proposed.join(allowed, [key, "url"]).select(key, F.col("position").cast("long").alias("position"), "url")
