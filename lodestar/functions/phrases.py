"""What questions, titles, claims and model outputs say, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

# Patterns and terms on which results depend.
CONSTRAINT = "至少|最多|不超过|不得|不能|不要|不含|必须|确保|等待|冷却|熄灭|超过|不到|低于|高于"
BOUNDARY = "至少|最多|不超过|超过|不到|低于|高于|大于|小于"
LIST_PREFIX = r"^\s*(?:[•●▪\-]+|[a-zA-Z0-9]+[.)、])\s*"
CAPABILITY = r"支持|具备|是否(?:可以|支持|有)|有没有.{0,12}(?:功能|接口|模式)|能否通过|可以通过"
CAPABILITY_STOPS = ("hak", "支持", "具备", "是否", "可以", "通过", "有没有", "功能", "接口", "模式")
MODES = {"purpose": "避免|防止|确保安全", "boundary": "边界|至少|最多|上限|下限|太厚|太薄", "safety": "能不能|立即|安全|危险|卡纸|高温|烫"}
PLAN_IDENTIFIER = r"(?i)(?:[a-z]{1,12}[\-_ ]?\d+[a-z0-9\-_]*|\b\d{2,}[a-z]?\b|[a-z]{1,5}\d{1,})"
SECTION = r"(?:第[一二三四五六七八九十百\d]+[章节部分]|目录|章节|概述|简介|讲了什么|有哪些内容)"
RELATION = r"(?:关系|区别|对比|比较|依赖|关联|影响|适配|兼容|先后|为什么)"
PROCEDURE = r"(?:怎么|如何|步骤|操作|安装|排查|维修|故障|解决|配置|测量)"
REFERENCES = ("这个", "那个", "它", "这款", "那款", "该产品", "这个产品", "那个产品", "这台", "那台", "刚才", "上面", "前面", "第一个", "第二个")
WARNING = "警告|安全|危险|注意"
PAGE = r"(?i)(?:page|页|第)\s*([0-9]{1,5})"
NUMBERED = r"^(\d+(?:\.\d+)*)\s+\S"
LEGACY_PART = r"^(\d+(?:\.\d+)+\s+.+)-[1-9]\d*$"
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".bmp", ".webp", ".tif", ".tiff")


def _none() -> Column:
    return F.array().cast("array<string>")


def constraints(text: Column) -> Column:
    """Parts of a text that state a constraint, without list marks, each once; a heading of a list is none."""
    parts = F.split(F.replace(text, F.lit("\r"), F.lit("\n")), r"(?<=[。！？；|])\n*|\n+|(?=\|)")
    bare = F.transform(parts, lambda x: F.btrim(F.regexp_replace(x, LIST_PREFIX, ""), F.lit(" \t|")))
    said = F.filter(bare, lambda x: ~x.rlike("[：:]$"))
    said = F.transform(said, lambda x: F.btrim(x, F.lit("：:")))
    return F.array_distinct(F.filter(said, lambda x: (F.length(x) >= 4) & x.rlike(CONSTRAINT)))


def numeric_boundaries(claims: Column) -> Column:
    """Those of some constraints that bound a number."""
    return F.filter(claims, lambda x: x.rlike(r"\d") & x.rlike(BOUNDARY))


def modes(query: Column) -> Column:
    """Why constraints matter to a question."""
    return F.array_compact(F.array(*(F.when(query.rlike(p), F.lit(m)) for m, p in MODES.items())))


def capability_terms(query: Column) -> Column:
    """Terms of the capability that a question asks for, without the question's own words and model numbers; empty if it asks for none."""
    bare = F.regexp_replace(query, "(?i)" + "|".join(sorted(CAPABILITY_STOPS, key=len, reverse=True)), "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\b[A-Za-z]{2,}[\s_-]*\d+[A-Za-z0-9_-]*\b", " "), "[吗呢么嘛？?]", " ")
    found = F.filter(T.terms(bare), lambda t: ~t.isin(*CAPABILITY_STOPS) & ~t.rlike(r"^\d+$"))
    return F.when(query.rlike(CAPABILITY), found).otherwise(_none())


def semantic_plan(query: Column, mode: str = "hybrid") -> Column:
    """(mode, intent, exact_terms, needs_tree, needs_graph, needs_dense): how a question is best searched."""
    exact = distinct_terms(F.regexp_extract_all(query, F.lit(f"({PLAN_IDENTIFIER})"), 1))
    section, relation, procedure, named = query.rlike(SECTION), query.rlike(RELATION), query.rlike(PROCEDURE), F.size(exact) > 0
    intent = F.when(relation, "relation").when(section, "section_navigation").when(procedure, "procedure").when(named, "exact_lookup").otherwise("semantic_lookup")
    plain = mode.strip().lower() in ("pageindex", "pageindex_first", "lexical", "semantic")
    way = F.lit("pageindex_fts") if plain else F.when(named | section, "fts_pageindex_dense_fallback").otherwise("hybrid_pageindex_dense")
    return F.struct(way.alias("mode"), intent.alias("intent"), exact.alias("exact_terms"), (section | ~named).alias("needs_tree"), relation.alias("needs_graph"), F.lit(not plain).alias("needs_dense"))


def distinct_terms(values: Column) -> Column:
    """Terms without blanks around them, the first of those that differ in case only."""
    named = F.filter(F.transform(values, lambda x: F.trim(x)), lambda x: x != "")
    low = F.transform(named, lambda x: F.lower(x))
    return F.filter(named, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def ordered_distinct(values: Column) -> Column:
    """Values without blanks around them, blank ones dropped, the first of equal ones kept."""
    return F.array_distinct(F.filter(F.transform(F.array_compact(values), lambda x: F.trim(x)), lambda x: x != ""))


def without_names(question: Column, names: list[str]) -> Column:
    """A question without item names, whatever white space stands between their characters."""
    import re

    for name in (n.replace(" ", "") for n in names if n.strip()):
        question = F.regexp_replace(question, "(?i)" + r"\s*".join(re.escape(c) for c in name), "")
    return T.normalized(question)


def without_fence(text: Column) -> Column:
    """A model's JSON without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def model_names(text: Column, length: int = 20) -> Column:
    """Entity names of a model's JSON, shortened, each once; empty if it can't be read."""
    found = F.from_json(without_fence(text), "entities array<string>").getField("entities")
    return F.coalesce(ordered_distinct(F.transform(found, lambda x: F.substring(F.trim(x), 1, length))), _none())


def refers_back(text: Column) -> Column:
    """Whether a question names something by a pronoun only."""
    return text.rlike("|".join(REFERENCES))


def canonical_title(title: Column) -> Column:
    """A title without heading marks and without the number that an older splitter put behind a table's parts."""
    bare = F.regexp_replace(F.trim(F.coalesce(title, F.lit(""))), r"^#+\s*", "")
    part = F.regexp_extract(bare, LEGACY_PART, 1)
    return F.trim(F.when(part != "", part).otherwise(bare))


def source_type(source: Column, title: Column, file_title: Column, has_table: Column, has_image: Column) -> Column:
    """What kind of evidence a row is."""
    no = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(source == "web", "web").when(no(has_table), "table").when(no(has_image), "image").when(F.coalesce(title, F.lit("")).rlike(WARNING), "safety_manual")
        .when(F.contains(F.coalesce(file_title, F.lit("")), F.lit("说明书")), "product_manual").otherwise("knowledge_base")
    )


def page_number(explicit: Column, title: Column, content: Column) -> Column:
    """The page that a row states, else the first that its title or content names."""
    said = F.regexp_extract(F.concat_ws(" ", title, content), PAGE, 1)
    return F.coalesce(explicit.try_cast("int"), said.try_cast("int"))


def heading_number(title: Column) -> Column:
    """A numbered heading's parts, null without a number or if one is too long."""
    parts = F.transform(F.split(F.regexp_extract(T.normalized(title), NUMBERED, 1), r"\."), lambda x: x.try_cast("int"))
    return F.when(~F.exists(parts, lambda x: x.isNull()), parts)


def next_sibling(number: Column, previous: Column, pages: Column) -> Column:
    """Whether a heading's number follows another on its level, on the same page or the next."""
    n = F.size(number)
    same = (n >= 2) & (n == F.size(previous)) & (F.slice(number, 1, n - 1) == F.slice(previous, 1, n - 1))
    return F.coalesce(same & (F.element_at(number, -1) == F.element_at(previous, -1) + 1) & pages.between(0, 1), F.lit(False))


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Whether two half-open ranges share a place."""
    return (start < other_end) & (other_start < end)


def triple_text(item: Column, head: Column, rel: Column, tail: Column) -> Column:
    """A triple as text, null if one of its parts is blank."""
    h, r, t, i = (F.trim(F.coalesce(c, F.lit(""))) for c in (head, rel, tail, item))
    said = F.concat(h, F.lit(" -("), r, F.lit(")-> "), t)
    return F.when((h != "") & (r != "") & (t != ""), F.when(i != "", F.concat(F.lit("["), i, F.lit("] "), said)).otherwise(said))


def subject_hash(subject: Column) -> Column:
    return F.substring(F.sha2(subject, 256), 1, 12)


def official_query(query: Column, names: list[str], domains: list[str], fresh: Column, limit: int = 3) -> Column:
    """A question about current facts, narrowed to official sites."""
    named = " ".join(n.strip() for n in names if n.strip())
    sites = " OR ".join(f"site:{d}" for d in domains[:limit])
    return F.when(fresh, F.trim(F.concat(query, F.lit(f" {named} 官方 ({sites})")))).otherwise(query) if domains else query


def safe_image_path(path: Column) -> Column:
    """A relative path to an image that stays below its folder; decided on the path alone, without touching files."""
    p = F.trim(F.coalesce(path, F.lit("")))
    unix = F.replace(p, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(unix, "/"), lambda x: ~x.isin("", "."))
    # Depth after each part: it must never fall below the folder.
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")), lambda s, x: F.struct((s["d"] + F.when(x == "..", -1).otherwise(1)).alias("d"), (s["ok"] & ((x != "..") | (s["d"] > 0))).alias("ok")))
    suffix = F.lower(F.regexp_extract(unix, r"[^/](\.[^./]+)$", 1))
    odd = unix.rlike(r"^(?:/|[A-Za-z][A-Za-z0-9+.-]*:)") | F.contains(p, F.lit("\0"))
    return (p != "") & ~odd & suffix.isin(*IMAGE_SUFFIXES) & depth["ok"]
