from __future__ import annotations

import math
import random

from lodestar.operators import replay as R

COLUMNS = "case_id long, candidate_id long, raw double, authority double, structure double, freshness double, group_id string, source string, relevant boolean"


def test_a_sweep_equals_ranking_once_per_setting(spark):
    rng = random.Random(5)
    pick = lambda *x: rng.choice(x)
    rows = [(c, i, pick(None, -2.0, rng.uniform(-9, 4)), pick(None, 0.45, 1.0), pick(None, 0.5), pick(0.4, 1.0), pick("g1", "g2", "g3"), pick("web", "local"), pick(True, False, None)) for c in range(60) for i in range(rng.randrange(1, 9))]
    settings = [R.Calibration("a"), R.Calibration("b", 0.0, 0.01), R.Calibration("c", -5.0, 3.0, (0.0, 0.5, 0.5, 0.0)), R.Calibration("d", 1.0, 0.0)]
    got = {(r["name"], r["case_id"]): r for r in R.audited(spark.createDataFrame(rows, COLUMNS).repartition(5), settings).collect()}
    for s in settings:
        margins, moved, good = [], 0, 0
        for c in range(60):
            own = [r for r in rows if r[0] == c]
            best = {}
            for _, i, raw, authority, structure, fresh, group, source, relevant in own:
                rel = 0.5 if raw is None else round(1 / (1 + math.exp(max(-60.0, min(60.0, -(raw - s.center) / max(abs(s.scale), 1e-6))))), 6)
                signals = (rel, 1.0 if authority is None else authority, structure or 0.0, fresh)
                score = round(sum(a * b for a, b in zip(signals, s.weights, strict=True)) + 1e-9, 6)
                best[group] = min(best.get(group, (math.inf,)), (-score, -rel, i, source, relevant), key=lambda x: x[:3])
            order = sorted(best.items(), key=lambda x: (*x[1][:2], x[0]))
            first = min(own, key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
            g = got[s.name, c]
            margin = round(-order[0][1][0] + (order[1][1][0] if len(order) > 1 else 0), 6)
            assert (g["top_group"], g["top_source"], g["groups"], g["first_source"], g["relevant"]) == (order[0][0], order[0][1][3], len(best), first[7], order[0][1][4])
            assert abs(g["margin"] - margin) < 2e-6 and g["moved"] == (order[0][0] != first[6]) and g["scores"] == sum(r[2] is not None for r in own)
            margins.append(margin)
            moved += order[0][0] != first[6]
            good += bool(order[0][1][4])
        row = [r for r in R.sweep(spark.createDataFrame(rows, COLUMNS), [s]).collect()][0]
        assert (row["cases"], row["moved"]) == (60, moved) and abs(row["relevant_rate"] - good / 60) < 1e-5 and abs(row["mean_margin"] - sum(margins) / 60) < 1e-5
    assert R.audited(spark.createDataFrame([], COLUMNS), settings).count() == 0


def test_fingerprints_see_changes_but_no_order(spark):
    schema = "a long, b string, c array<int>, d double, e binary"
    rows = [(i, f"b{i}" if i % 3 else None, [i, 1], i / 7, bytes([i])) for i in range(50)]
    frame = lambda r: spark.createDataFrame(r, schema)
    one = lambda df: R.fingerprint(df).first()["fingerprint"]
    base = one(frame(rows))
    assert base == one(frame(rows[::-1]).repartition(7)) == one(frame(rows).select("e", "c", "a", "d", "b"))
    changed = [frame([*rows, rows[3]]), frame(rows[1:]), frame([*rows[1:], (0, "", [0, 1], 0.0, b"\0")]), frame([*rows[:-1], (49, "b49", [49], 7.0, bytes([49]))]), frame(rows).withColumnRenamed("a", "z"), frame([])]
    assert len({base, *map(one, changed)}) == 1 + len(changed)
    # Values that run into each other, and a null beside its sign, differ.
    two = lambda *r: one(spark.createDataFrame([r], "x string, y string"))
    assert len({two("a,y=1:b", "c"), two("a", "b"), two(None, "b"), two("-", "b"), two("", "b")}) == 5


def test_reports_are_lines_in_order(spark, tmp_path):
    from lodestar.operators import report

    results = spark.createDataFrame([("a", True, 0.5, 10.0, None), ("b", None, None, None, ["x", "y"])], "case_id string, passed boolean, score double, latency_ms double, review array<string>")
    metrics = spark.createDataFrame([("m", 0.25)], "name string, value double")
    none = spark.createDataFrame([], "reason string")
    out = report.lines(results, metrics, none)
    said = [r["line"] for r in out.orderBy("part", "at").collect()]
    assert said == ["# Evaluation", "Passed: 1 of 2", "Latency: 10.0 ms at the median, 10.0 ms at 95 %", "## Eligibility", "- fit to be a baseline", "## Metrics", "- m: 0.2500", "## Review", "- b: x; y", "## Cases", "- a: pass, score 0.5000, 10.0 ms", "- b: FAIL, score 0.0000, 0.0 ms"]
    report.write(out, str(tmp_path / "r"))
    files = sorted((tmp_path / "r").glob("part-*"))
    assert "".join(f.read_text() for f in files).splitlines() == said
    empty = report.lines(results.limit(0), metrics.limit(0), spark.createDataFrame([("r",)], "reason string")).orderBy("part", "at").collect()
    assert [r["line"] for r in empty][1:5] == ["Passed: 0 of 0", "Latency: 0.0 ms at the median, 0.0 ms at 95 %", "## Eligibility", "- r"]


def test_all_chunks_bear_one_name(spark):
    from lodestar.operators import report

    chunks = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (3, "w")], "doc_id long, item_name string")
    names = spark.createDataFrame([(1, " b "), (1, "a"), (2, " "), (2, None)], "doc_id long, name string")
    docs = spark.createDataFrame([(1, "f1"), (2, "f2"), (3, "f3")], "doc_id long, file_title string")
    assert sorted((r["doc_id"], r["item_name"]) for r in report.with_item_names(chunks, names, docs).collect()) == [(1, "a"), (1, "a"), (2, "f2"), (3, "f3")]
