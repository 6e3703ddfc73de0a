from __future__ import annotations

import random

import numpy as np

from lodestar.llm import decontaminate as dc


def plain_sw(a, b):
    s = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s[i, j] = max(0, s[i - 1, j - 1] + (dc.MATCH if a[i - 1] == b[j - 1] else dc.MISMATCH), s[i - 1, j] + dc.GAP, s[i, j - 1] + dc.GAP)
    return int(s.max())


def test_alignment_equals_the_plain_table():
    rng = np.random.default_rng(4)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 25))
        score, start, end = dc.smith_waterman(a, b)
        assert score == plain_sw(a, b)
        assert score == 0 or plain_sw(a, b[start:end]) == score


def test_copies_are_found_and_others_left_alone(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 40)))) for i in range(20)] + [(90, None), (91, ""), (92, "zqx zqy zqz")]
    docs, want = [], set()
    for d in range(200):
        text = [word() for _ in range(rng.randint(0, 300))]
        if d % 4 == 0:
            i = rng.randrange(20)
            copy = items[i][1].split()
            kind = rng.randrange(3)
            if kind == 1:  # edited: one word in eight replaced
                copy = [word() if k % 8 == 7 else w for k, w in enumerate(copy)]
            if kind == 2:
                copy = [w.upper() + "," for w in copy]
            at = rng.randint(0, len(text))
            text[at:at] = copy
            want.add((d, i))
        docs.append((d, " ".join(text), 1.0))
    docs += [(500, "before zqx zqy zqz after", 1.0), (501, None, 1.0), (502, "", 1.0), (500, "before zqx zqy zqz after", 1.0)]
    want.add((500, 92))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string, score double"), spark.createDataFrame(items, "item_id long, text string")
    got = dc.contaminated(df, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    left = {r["doc_id"] for r in dc.clean(df, bench).collect()}
    assert left == {d for d, _, _ in docs} - {d for d, _ in want}
    assert dc.contaminated(df.limit(0), bench).count() == 0 and dc.contaminated(df, bench.limit(0)).count() == 0


def test_edges(spark, edge_docs):
    bench = spark.createDataFrame([(1, "one"), (None, None)], "item_id long, text string")
    assert {r["doc_id"] for r in dc.contaminated(edge_docs, bench).collect()} == {4, 5}


def test_many_copies_do_not_hide_an_edited_one(spark):
    """Of each item 60 exact copies and one that is edited, at another place each time."""
    docs, items = [(1, "nothing of the kind stands here")], []
    for i in range(15):
        words = [f"w{i}x{k}" for k in range(15)]
        items.append((i, " ".join(words)))
        docs += [(1000 * i + 100 + d, items[i][1]) for d in range(60)]
        docs.append((1000 * i + 200, " ".join(words[:i] + ["other"] + words[i + 1 :])))
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, d // 1000) for d, _ in docs if d > 1}


def test_what_reaches_the_least_score_is_found(spark):
    """Copies with one word in five or in three replaced, with words put in or left out, against the plain table over all pairs."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 4)))
    items = [[word() for _ in range(n)] for n in (15, 15, 21, 30)]
    docs = []
    for item in items:
        copies = [[word() if k % step == 1 else w for k, w in enumerate(item)] for step in (5, 4, 3, 2)]
        copies += [[x for w in item for x in (w, word())], [x for k, w in enumerate(item) for x in ((w, word()) if k % 3 == 0 else (w,))]]
        copies += [[w for k, w in enumerate(item) if k % 3 != 1], item[: len(item) // 2], item[len(item) // 2 - 1 :]]
        copies += [[word() if rng.random() < share else w for w in item] for share in (0.2, 0.3, 0.4)]
        docs += [[word() for _ in range(rng.randint(0, 30))] + copy + [word() for _ in range(rng.randint(0, 30))] for copy in copies]
    want = {(d, i): s for d, text in enumerate(docs) for i, item in enumerate(items) if (s := plain_sw(item, text) / (dc.MATCH * len(item))) >= dc.MIN_SCORE}
    assert len(want) >= 28
    got = dc.contaminated(spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(docs)], "doc_id long, text string"), spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["score"] for r in got} == want


def test_scores_side_by_side_are_those_of_single_alignments():
    rng = np.random.default_rng(9)
    items = [rng.integers(2, 12, n).astype(np.uint64) for n in rng.integers(1, 30, 80)]
    passages = [rng.integers(2, 12, n).astype(np.uint64) for n in rng.integers(0, 90, 80)]
    want = [dc.smith_waterman(a, b)[0] for a, b in zip(items, passages, strict=True)]
    assert dc.best_scores(items, passages, 500).tolist() == want
    assert dc.best_scores([], []).tolist() == []
