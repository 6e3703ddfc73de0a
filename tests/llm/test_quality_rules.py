from __future__ import annotations

import duckdb

from lodestar.llm import quality_rules
from lodestar.llm.queries import oracle_sql
from tests.oracle import rows_of


def test_edges_equal_the_sql(edge_docs, no_docs):
    got = quality_rules.judge(edge_docs).toPandas()
    con = duckdb.connect()
    con.register("documents", edge_docs.select("doc_id", "text").toArrow())
    assert rows_of(got) == rows_of(con.execute(oracle_sql()["op9_quality_rules"]).df())
    assert quality_rules.judge(no_docs).count() == 0


def test_no_user_function_in_the_plan(edge_docs):
    plan = quality_rules.judge(edge_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_repeat_words_against_a_plain_count(spark):
    text = " ".join(["a b c d", "x a b c y", "b c d z", "a a a a a"])
    w = text.split()
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + j for i, t in enumerate(tri) if tri.count(t) > 1 for j in range(3)}
    row = quality_rules.judge(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row["n_repeat_words"] == len(covered)
