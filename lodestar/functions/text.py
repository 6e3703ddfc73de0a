"""Text functions as column expressions that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a question, in the language of the product manuals.
STOP_TERMS = (
    "什么", "怎么", "如何", "多少", "是否", "可以", "能不能", "需要", "关于",
    "使用", "设备", "产品", "分别", "对应", "说明", "给出", "当前", "问题",
)
# Phrases of a refusal and of a question back, looked for in this order.
REFUSALS = ("没有足够依据", "没有检索到足够", "证据不足", "不足以支持", "无法回答", "无法提供", "不能提供", "不具备", "未找到", "不确定")
QUESTIONS_BACK = ("请提供", "请补充", "您指的是", "具体产品", "具体型号")
HEDGES = ("没有足够依据", "证据不足", "无法提供", "请提供", "请补充")
# Terms that switch a query's features on.
FEATURES = {
    "kg": "关系|关联|组成|部件|属于|依赖|供应商|上下游|知识图谱",
    "safety": "安全|警告|危险|烫伤|高温|触电|冷却|锁定|卡纸",
    "table": "表格|参数|规格|边界|上限|下限|重量|尺寸|范围",
    "image": "图片|示意图|位置|外观|面板|指示灯|接线",
}
WORD = r"[A-Za-z][A-Za-z0-9_/-]+"
CJK = r"[㐀-鿿]+"
IDENTIFIER = r"(?i)[a-z]{1,12}[\-_ ]?\d+[a-z0-9\-_]*|\b\d{2,}[a-z]?\b"
SENTENCE_END = r"(?<=[。！？；.!?;\n])"
CLAIM_END = r"(?<=[。！？；\n])"


def normalized(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def heading(text: Column) -> Column:
    """A heading without its leading number signs."""
    return F.trim(F.regexp_replace(F.trim(text), r"^#{1,6}\s+", ""))


def _bigrams(run: Column) -> Column:
    pairs = F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))
    return F.when(F.length(run) >= 2, pairs).when(F.length(run) == 1, F.array(run)).otherwise(F.array().cast("array<string>"))


def terms(text: Column) -> Column:
    """Distinct terms: words of two letters or more, and pairs of CJK characters; bracketed parts and stop terms don't count."""
    low = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"\[[^\]]+\]", " "))
    words = F.regexp_extract_all(low, F.lit(f"({WORD})"), 1)
    stops = "|".join(STOP_TERMS)
    runs = F.transform(F.regexp_extract_all(low, F.lit(f"({CJK})"), 1), lambda r: F.regexp_replace(r, stops, ""))
    return F.array_distinct(F.array_except(F.concat(words, F.flatten(F.transform(runs, _bigrams))), F.array(*map(F.lit, STOP_TERMS))))


def coverage(query_terms: Column, evidence_terms: Column) -> Column:
    """The share of the query's terms that the evidence has; none asked for: 0."""
    return F.when(F.size(query_terms) == 0, F.lit(0.0)).otherwise(F.round(F.size(F.array_intersect(query_terms, evidence_terms)) / F.size(query_terms), 6))


def identifiers(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({IDENTIFIER})"), 1), F.lower))


def numbers(text: Column) -> Column:
    """Distinct numbers that don't follow a letter, without zeros that only format them."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![A-Za-z])(\d+(?:\.\d+)?)"), 1)
    plain = lambda n: F.regexp_replace(F.regexp_replace(n, r"^0+(?=\d)", ""), r"(\.\d*?)0+$", "$1")
    return F.array_distinct(F.transform(found, lambda n: F.regexp_replace(plain(n), r"\.$", "")))


def pieces(text: Column, end: str = SENTENCE_END) -> Column:
    """Pieces that keep their closing mark, none of them blank."""
    return F.filter(F.split(text, end), lambda x: F.trim(x) != "")


def citations(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), 1), lambda n: n.try_cast("int"))


def without_citations(text: Column) -> Column:
    return F.regexp_replace(text, r"\[\d+\]", "")


def is_claim(text: Column) -> Column:
    """Whether a piece states something: four characters or more beside list marks, no hedge, a letter, digit or CJK character."""
    bare = F.regexp_replace(text, r"^[ \t\r\n\-*#：:]+|[ \t\r\n\-*#：:]+$", "")
    return (F.length(bare) >= 4) & ~bare.rlike("|".join(HEDGES)) & bare.rlike(r"[㐀-鿿A-Za-z0-9]")


def behavior(answer: Column) -> Column:
    return F.when(answer.rlike("|".join(REFUSALS)), "refuse").when(answer.rlike("|".join(QUESTIONS_BACK)), "clarify").otherwise("answer")


def features(query: Column) -> Column:
    return F.struct(*(query.rlike(p).alias(name) for name, p in FEATURES.items()))


def url_key(url: Column) -> Column:
    """Scheme and host in lower case, no closing slash of the path, query kept, fragment dropped."""
    part = lambda i: F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(?:#.*)?$", i)
    return F.when(part(1) == "", url).otherwise(F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.regexp_replace(part(3), "/+$", ""), part(4)))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def safe_url(url: Column) -> Column:
    """http or https, a host, nobody's name in it, no white space."""
    return url.rlike(r"^(?i)https?://[^/?#@\s]+(?:[/?#]\S*)?$")


def official(host_name: Column, domains: list[str]) -> Column:
    """The host is one of the domains or lies below one."""
    hit = F.lit(False)
    for d in domains:
        hit = hit | (host_name == d) | host_name.endswith(f".{d}")
    return hit


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(F.substring(normalized(F.lower(text)), 1, 1000), 256), 1, 20)


def stable_id(prefix: str, *parts: Column, length: int = 24) -> Column:
    """A prefix and the head of the SHA-256 of the parts as a JSON array of strings."""
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha2(F.to_json(F.array(*(p.cast("string") for p in parts))), 256), 1, length))


def preview(text: Column, length: int = 280) -> Column:
    return F.when(F.length(text) > length, F.concat(F.substring(text, 1, length), F.lit("…"))).otherwise(text)
