from __future__ import annotations

import random
import re
import unicodedata

from pyspark.sql import functions as F

from lodestar.functions import phrases as P
from lodestar.functions import text as T
from lodestar.operators import completion as C
from lodestar.operators import outline as O
from lodestar.plans import completion as plans

SF = "/root/testdata/sf0.001"


def form(text):
    folded = unicodedata.normalize("NFKC", text).casefold().replace("平方米", "m2").replace("平方毫米", "mm2")
    return re.sub(r"\s+", "", folded)


def numbers(text):
    return {str(float(n)) for n in re.findall(r"(?<![A-Za-z])\d+(?:\.\d+)?", text)}


def terms(text):
    low = re.sub(r"\[[^]]+]", " ", text).lower()
    out = set(re.findall(r"[a-z][a-z0-9_/-]+", low))
    for run in re.findall(r"[㐀-鿿]+", low):
        for stop in T.STOP_TERMS:
            run = run.replace(stop, "")
        out |= {run} if len(run) == 1 else {run[i : i + 2] for i in range(len(run) - 1)}
    return {t for t in out if t and t not in T.STOP_TERMS}


def covered(candidate, text):
    c, a = form(candidate), form(text)
    shared = len(terms(c) & terms(a))
    if numbers(c):
        return numbers(c) <= numbers(a) and shared > 0
    if not terms(c):
        return c in a
    marked = set(re.findall(P.CONSTRAINT, c)) & set(re.findall(P.CONSTRAINT, a))
    return shared / len(terms(c)) >= 0.6 or bool(marked) and shared >= 2


def plain(answer, content, query):
    """(appended, completed) by one loop over the candidates."""
    modes = [m for m, p in P.MODES.items() if re.search(p, query)]
    found = []
    for part in re.split(r"(?<=[。！？；])|\n+|(?=\|)|(?<=\|)", content or "") if modes else []:
        part = re.sub(P.LIST_PREFIX, "", part).strip(" \t|")
        claim = part.strip("：:")
        if part.endswith(("：", ":")) or len(claim) < 4 or not re.search(P.CONSTRAINT, claim) or claim in found:
            continue
        if modes == ["boundary"] and not (re.search(r"\d", claim) and re.search(P.BOUNDARY, claim)):
            continue
        found.append(claim)
    body, mark, images = answer.partition(C.IMAGES)
    said, added = body, []
    for claim in found:
        if len(added) < C.MOST and not covered(claim, said):
            added.append(claim)
            said += "\n" + claim
    if not added:
        return [], answer
    out = body.rstrip()
    out += "。" if out and out[-1] not in C.ENDS else ""
    for claim in added:
        out += ("\n" if out else "") + claim.rstrip(C.ENDS) + "[1]。"
    return added, out + ("\n" + mark + images if mark else "")


def test_query_equals_a_plain_loop(spark):
    rows = plans.cases(spark, SF).collect()
    got = {r["doc_id"]: r for r in plans.completed(spark, SF).collect()}
    kinds = set()
    for r in rows:
        added, whole = plain(r["answer"], r["content"], r["query"])
        kinds.add(len(added))
        assert (got[r["doc_id"]]["appended"], got[r["doc_id"]]["completed"]) == ("|".join(added), whole), r
    assert {0, 4} <= kinds and len(kinds) > 2


def test_what_was_added_covers_what_follows(spark):
    rows = [(1, "", "必须断电后再清洗设备。清洗设备必须断电。不得用水", "如何避免危险"), (2, "答。", "至少3厘米。至少 3.0 厘米。确保断电", "厚度至少多少"), (3, None, None, "能不能用"), (4, "a", "必须断电断电", None), (5, "", "不要用水；不要用水；" * 3 + "必须等待；确保断电；不得拆卸；不能倾斜；不含电池", "安全")]
    got = {r["i"]: r for r in C.completed(spark.createDataFrame(rows, "i int, answer string, content string, query string")).collect()}
    for i, answer, content, query in rows:
        added, whole = plain(answer or "", content, query or "")
        assert (list(got[i]["appended"]), got[i]["completed"]) == (added, whole), i
    assert len(got[1]["appended"]) == 2 and got[2]["appended"] == ["至少3厘米。"] and len(got[5]["appended"]) == C.MOST


def test_facts_need_a_source_that_bears_them(spark):
    answers = spark.createDataFrame([(1, "电池容量是 5 Ah。[1]\n外壳防水[2]！其他。"), (2, None)], "case_id long, answer string")
    facts = spark.createDataFrame([(1, 0, ["5AH"], ["电池"]), (1, 1, ["外壳防水"], ["别的"]), (1, 2, ["其他"], []), (1, 3, ["没有的"], None), (2, 0, ["x"], []), (1, 4, [], []), (1, 5, None, None)], "case_id long, fact long, alternatives array<string>, titles array<string>")
    sources = spark.createDataFrame([(1, 1, "# 电池", None, None, True), (1, 2, "外壳", None, "外壳防水等级", False)], "case_id long, rank long, title string, parent_title string, content string, reviewed boolean")
    got = {(r["case_id"], r["fact"]): tuple(r)[2:] for r in C.cited_facts(answers, facts, sources).collect()}
    assert got == {(1, 0): (True, True, 0, 1), (1, 1): (True, True, 1, 2), (1, 2): (True, False, None, None), (1, 3): (False, False, None, None), (2, 0): (False, False, None, None), (1, 4): (False, False, None, None), (1, 5): (False, False, None, None)}
    bare = sources.withColumn("content", F.lit(None).cast("string"))
    again = {(r["case_id"], r["fact"]): r["cited"] for r in C.cited_facts(answers, facts, bare).collect()}
    assert again[1, 0] and not again[1, 1]


ITEMS = "doc_id long, page long, item long, type string, level int, text string, captions array<string>"


def siblings(rows):
    """The captions that open sections, by one walk."""
    out, anchor = [], None
    flat = {r[4] for r in rows if r[3] == "title"} == {1}
    number = lambda t: tuple(map(int, m[1].split("."))) if (m := re.match(P.NUMBERED, " ".join((t or "").split()))) else None
    for _, page, item, kind, _, text, captions in sorted(rows, key=lambda r: (r[1], r[2])):
        if kind == "title" and (n := number(text)):
            anchor = (n, page, item)
        elif flat and anchor and kind == "table" and captions and len(captions) == 1 and (n := number(captions[0])):
            last, last_page, last_item = anchor
            if len(n) > 1 and n == (*last[:-1], last[-1] + 1) and 0 <= page - last_page <= 1:
                out.append((page, item, last_page, last_item))
                anchor = (n, page, item)
    return out


def test_recovered_headings_equal_a_walk(spark):
    rng = random.Random(7)
    rows, want = [], []
    for doc in range(60):
        own = []
        for item in range(rng.randrange(40)):
            n = rng.choice([*[f"1.{item}"] * 12, f"1.{item // 2}", "2", f"1.1.{item}", "", "99999999999999999999.1"])
            kind = rng.choice(["title", "table", "table", "paragraph"])
            captions = rng.choice([*[[f"{n} cap"]] * 8, [f"{n} cap", "x"], [], None]) if kind == "table" else None
            own.append((doc, item // 5, item, kind, (2 if doc % 5 == 0 and item == 3 else 1) if kind == "title" else None, f" {n}  Title" if kind == "title" else None, captions))
        rows += own
        want += [(doc, *x) for x in siblings([r for r in own if "999" not in str(r)])]
    d = spark.createDataFrame(rows, ITEMS)
    got = sorted((r["doc_id"], r["page"], r["item"], r["anchor_page"], r["anchor_item"]) for r in O.recovered_headings(d.repartition(6)).collect())
    assert got == sorted(want) and len(want) > 20
    assert O.recovered_headings(d.limit(0)).count() == 0


def test_recovered_tables_open_sections(spark):
    rows = [(1, 1, 0, "title", 1, "1.1 One", None), (1, 1, 1, "paragraph", None, "text", None), (1, 2, 2, "table", None, "cells", ["1.2 Two"]), (1, 2, 3, "paragraph", None, "more", None)]
    t = O.with_recovered(spark.createDataFrame(rows, ITEMS)).withColumn("position", F.col("item"))
    assert [r["title_path"] for r in O.with_titles(t, title="title").orderBy("position").collect()] == [["1.1 One"], ["1.1 One"], ["1.2 Two"], ["1.2 Two"]]
