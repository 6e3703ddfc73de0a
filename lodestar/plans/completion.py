"""Answer queries: completion by constraints, facts with the sentence and source that bear them, images of cited sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import completion as C
from .registry import query, table


def cases(spark: SparkSession, sf: str) -> DataFrame:
    """Questions, answers and evidence with constraints whose numbers come from each document; answers say some of them already."""
    n = F.length(F.coalesce("text", F.lit("")))
    num = lambda k: (1 + n % k).cast("string")
    rules = [
        F.concat(F.lit("厚度至少"), num(9), F.lit("厘米")), F.concat(F.lit("• 重量不得超过"), num(7), F.lit("公斤")), F.concat(F.lit("开盖前必须等待冷却"), num(5), F.lit("分钟")), F.lit("确保设备已断电"), F.lit("不要用水清洗设备"),
        F.concat(F.lit("最多装"), num(11), F.lit("张纸")), F.lit("设备必须断电后清洗"), F.lit("确保："), F.lit("面积不超过3 平方米"),
    ]
    order = F.transform(F.sequence(F.lit(0), F.lit(len(rules) - 1)), lambda i: F.get(F.array(*rules), ((i * 4 + F.col("doc_id")) % len(rules)).cast("int")))
    content = F.array_join(order, "。")
    ask = F.get(F.array(*map(F.lit, ("厚度上限是多少", "如何避免危险", "能不能立即开盖", "这是什么", "边界和安全"))), (F.col("doc_id") % 5).cast("int"))
    said = F.array_join(F.slice(order, 1 + F.col("doc_id") % 3, F.col("doc_id") % 4), "，")
    images = F.when(F.col("doc_id") % 6 == 2, C.IMAGES + "http://h/a.png")
    return table(spark, sf, "documents").select("doc_id", ask.alias("query"), F.concat(said, F.when(F.col("doc_id") % 2 == 0, "。 ").otherwise(""), F.coalesce(images, F.lit(""))).alias("answer"), F.when(F.col("doc_id") % 13 > 0, content).alias("content"))


@query("x11_completed")
def completed(spark: SparkSession, sf: str) -> DataFrame:
    """Answers with the constraints that they leave out; a fold in which each addition counts for the next, tested against a plain loop over the same rows."""
    return C.completed(cases(spark, sf)).select("doc_id", F.array_join("modes", ",").alias("modes"), F.size("candidates").alias("candidates"), F.array_join("appended", "|").alias("appended"), "completed")


_WORDS = "regexp_extract_all(lower(text), '[a-z]{3,}')"
# Sentences of three words each; the first two are cited behind their end, one citation leads nowhere, the last sentence has none.
_J19 = rf"""WITH d AS (SELECT doc_id AS case_id, {_WORDS} AS w, coalesce(source, '') AS source, coalesce(lang, '') AS lang FROM documents WHERE len({_WORDS}) >= 6),
s AS (SELECT case_id, w, source, lang, unnest([{{'i': 0, 's': w[1] || '是' || w[2], 'c': [1], 't': [w[1], w[2], '是']}}, {{'i': 1, 's': w[3] || '用' || w[4], 'c': [2, 9], 't': [w[3], w[4], '用']}}, {{'i': 2, 's': w[1] || '是' || w[2] || '也无需' || w[5], 'c': [2], 't': [w[1], w[2], w[5], '是', '也无', '无需']}}, {{'i': 3, 's': w[6], 'c': CAST([] AS INTEGER[]), 't': [w[6]]}}]) AS x FROM d),
f AS (SELECT case_id, unnest([{{'f': 1, 'a': w[1] || '是' || w[2], 'l': source}}, {{'f': 2, 'a': w[3] || '用' || w[4], 'l': ''}}, {{'f': 3, 'a': '不需要' || w[5], 'l': 'other'}}, {{'f': 4, 'a': w[6], 'l': ''}}, {{'f': 5, 'a': 'qqqq', 'l': ''}}]) AS y FROM d),
h AS (SELECT f.case_id, y.f AS fact, y.l AS title, x.i AS sentence, x.t AS t, unnest(x.c) AS rank FROM f JOIN s ON s.case_id = f.case_id AND contains(replace(x.s, '无需', '不需要'), y.a)),
o AS (SELECT case_id, 1 AS rank, source AS title, CAST([] AS VARCHAR[]) AS ct, case_id % 2 = 0 AS ok FROM d UNION ALL SELECT case_id, 2, lang, [w[3], w[4], '用'], CASE WHEN case_id % 3 > 0 THEN case_id % 3 = 1 END FROM d),
m AS (SELECT h.case_id, fact, min({{'a': sentence, 'b': h.rank}}) AS b FROM h JOIN o USING (case_id, rank)
  WHERE len(list_intersect(list_distinct(t), ct)) / len(list_distinct(t)) >= 0.08 OR (coalesce(ok, true) AND (h.title = '' OR h.title = o.title OR h.title = 'p')) GROUP BY h.case_id, fact),
p AS (SELECT f.case_id, y.f AS fact, bool_or(contains(replace(x.s, '无需', '不需要'), y.a)) AS present FROM f JOIN s USING (case_id) GROUP BY ALL)"""


@query("j19_fact_citations", f"{_J19} SELECT p.case_id, CAST(p.fact AS BIGINT) AS fact, present, b IS NOT NULL AS cited, CAST(b.a AS BIGINT) AS sentence, CAST(b.b AS BIGINT) AS rank FROM p LEFT JOIN m USING (case_id, fact)")
def fact_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Facts in several cited sentences, in one, in one that cites nothing, and in none; sources by content, by review, by title."""
    w = lambda i: F.get("w", F.lit(i - 1))
    found = F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{3,})"), 1)
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("case_id"), found.alias("w"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang")).filter("size(w) >= 6")
    say = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c))
    answers = d.select("case_id", say(w(1), "是", w(2), "。 [1]\n", w(3), "用", w(4), "[2][9]。", w(1), "是", w(2), "也无需 ", w(5), "[2]！", w(6)).alias("answer"))
    none = F.array().cast("array<string>")
    made = [(1, F.array(say(w(1), " 是", w(2))), F.array("source")), (2, F.array(F.lit(""), F.lit("zzzz"), say(w(3), "用", w(4))), none), (3, F.array(say("不需要", w(5))), F.array(F.lit("other"))), (4, F.array(w(6)), none), (5, F.array(F.lit("qqqq")), none)]
    facts = d.select("case_id", F.inline(F.array(*(F.struct(F.lit(i).cast("long").alias("fact"), a.alias("alternatives"), t.alias("titles")) for i, a, t in made))))
    reviewed = F.when(F.col("case_id") % 3 > 0, F.col("case_id") % 3 == 1)
    s = [F.struct(F.lit(1).alias("rank"), F.concat(F.lit("# "), "source").alias("title"), F.lit("p").alias("parent_title"), F.lit("").alias("content"), (F.col("case_id") % 2 == 0).alias("reviewed")), F.struct(F.lit(2).alias("rank"), F.col("lang").alias("title"), F.lit("p").alias("parent_title"), say(w(3), "用", w(4)).alias("content"), reviewed.alias("reviewed"))]
    return C.cited_facts(answers, facts, d.select("case_id", F.inline(F.array(*s))))


@query("p13_answer_images", """WITH d AS (SELECT doc_id, unnest([{'p': 0, 'i': 0}, {'p': 1, 'i': 1}, {'p': 2, 'i': 2}, {'p': 3, 'i': 3}]) AS x FROM documents)
SELECT doc_id AS case_id, CAST(x.p AS BIGINT) AS position, 'http://h/' || doc_id || '.' || x.i || '.png' AS url FROM d WHERE (x.i = 0 AND doc_id % 2 = 0) OR (x.i = 1 AND doc_id % 3 = 0) OR (x.i = 2 AND (doc_id % 2 = 0 OR doc_id % 3 = 0))""")
def answer_images(spark: SparkSession, sf: str) -> DataFrame:
    """Four images are shown; the first two sources are cited by some answers, the third by none."""
    url = lambda i: F.concat(F.lit("http://h/"), F.col("doc_id").cast("string"), F.lit(f".{i}.png"))
    cites = F.concat(F.lit("a"), F.when(F.col("doc_id") % 2 == 0, "[1]").otherwise(""), F.when(F.col("doc_id") % 3 == 0, "[2]").otherwise(""))
    d = table(spark, sf, "documents")
    answers = d.select(F.col("doc_id").alias("case_id"), F.concat(cites, F.lit("。" + C.IMAGES + "\n"), url(0), F.lit(")。\n"), url(1), F.lit(" "), url(2), F.lit(" "), url(0), F.lit(" "), url(3)).alias("answer"))
    held = F.array(*(F.struct(F.lit(r).alias("rank"), F.array(*map(url, i)).alias("image_urls")) for r, i in ((1, (0, 2)), (2, (2, 1)), (3, (3,)))))
    return C.answer_images(answers, d.select(F.col("doc_id").alias("case_id"), F.inline(held)))
