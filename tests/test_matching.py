"""Folds over small groups: matchings of candidates to overlapping selectors, greedy chunks."""

from __future__ import annotations

import itertools
import random
from difflib import SequenceMatcher

from lodestar.operators import blocks, documents, evaluation


def test_matched_is_largest_in_every_case_and_makes_no_group_per_case(spark):
    r = random.Random(3)
    rows = [(c, k, u) for c in range(60) for k in range(1, 5) for u in range(4) if r.random() < 0.4]
    found = evaluation.matched(spark.createDataFrame(rows, "case_id long, rank int, unit long"))
    got = [tuple(x) for x in found.collect()]
    assert set(got) <= set(rows)
    for c in range(60):
        mine, pairs = [(k, u) for case, k, u in got if case == c], [(k, u) for case, k, u in rows if case == c]
        assert len({k for k, _ in mine}) == len({u for _, u in mine}) == len(mine)
        units = [[u for k2, u in pairs if k2 == k] + [None] for k in range(1, 5)]
        most = max(len(named) for p in itertools.product(*units) if len(set(named := [u for u in p if u is not None])) == len(named))
        assert len(mine) == most
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" not in plan and "ArrowEvalPython" in plan


def test_greedy_chunks_equal_a_plain_loop_and_make_no_group_per_document(spark):
    r = random.Random(4)
    rows = [(d, p, r.randrange(0, 60)) for d in range(40) for p in range(r.randrange(1, 30))]
    found = documents.greedy_chunks(spark.createDataFrame(rows, "doc_id long, position int, chars long").orderBy("chars"), 100)
    want = []
    for d in range(40):
        mine: list[list[int]] = []
        for _, p, n in (x for x in rows if x[0] == d):
            if mine and mine[-1][3] + n + 1 <= 100:
                mine[-1][2:] = [p, mine[-1][3] + n + 1]
            else:
                mine.append([len(mine), p, p, n])
        want += [(d, *x) for x in mine]
    assert sorted(tuple(x) for x in found.collect()) == sorted(want)
    assert found.columns == ["doc_id", "chunk", "first", "last", "chars"]
    assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()


def test_ratios_equal_those_of_whole_comparisons(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdé \U0001f600") for _ in range(n))
    old = [(1, i, text(rng.choice([1, 5, 40, 60, 190, 210, 400]))) for i in range(60)]
    new = [(1, 100 + i, rng.choice([t + " revised", t[: len(t) // 2] + text(5) + t[len(t) // 2 :], "x" + t, t[1:] or "y", text(len(t))])) for _, i, t in old]
    want = {(i, j): r for _, i, o in old for _, j, n in new if (r := SequenceMatcher(None, n, o).ratio()) >= 0.7}
    frames = [spark.createDataFrame(rows, "doc_id long, position long, text string") for rows in (old, new)]
    assert {(r["old"], r["new"]): r["score"] for r in blocks.similar_pairs(*frames, ["doc_id"], 0.7).collect()} == want


def test_longest_common_subsequence_bounds_the_matching_blocks():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 90))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        found = blocks.subsequence_length(blocks.subsequence_masks(b), len(b), a)
        assert found == row[-1] >= sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
