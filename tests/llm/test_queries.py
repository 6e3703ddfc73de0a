from __future__ import annotations

import pytest

from lodestar.llm import queries as llm
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, name):
    assert differences(spark, llm.queries()[name], llm.oracle_sql()[name], SF) == []


@pytest.mark.parametrize("name", sorted(set(llm.queries()) - set(llm.oracle_sql())))
def test_runs(spark, name):
    rows = llm.queries()[name](spark, SF).count()
    documents = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert rows >= documents if name != "op4_decontamination" else 0 < rows < documents
