from __future__ import annotations

import corpus_pipeline as cp
from lodestar.llm import decontaminate, jaccard_join, language_id, toxicity

SF = "/root/testdata/sf0.001"


def test_each_stage_takes_effect_and_keeps_the_rest(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        out = cp.keep(stage(spark, docs, SF), name)
        assert out.columns == cp.COLUMNS and out.count() <= docs.count()
        before, after = {r["doc_id"] for r in docs.select("doc_id").collect()}, {r["doc_id"] for r in out.select("doc_id").collect()}
        gone = before - after
        if name == "toxicity":
            want = {r["doc_id"] for r in toxicity.classify(docs, spark.read.parquet(f"{SF}/labels.parquet")).filter("predicted = 1").collect()}
        elif name == "jaccard_join":
            want = {r["doc_id"] for r in jaccard_join.join(docs).filter("n_shingles > 0 and component_id < doc_id").collect()}
        elif name == "decontamination":
            want = {r["doc_id"] for r in decontaminate.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
        else:
            verdict = language_id.identify(docs).collect()
            want = {r["doc_id"] for r in verdict if r["lang_pred"] == language_id.UNKNOWN or r["score"] < cp.LEAST_SCORE}
            middle = sorted(r["score"] for r in verdict)[len(verdict) // 2]
            monkeypatch.setattr(cp, "LEAST_SCORE", middle)
            assert stage(spark, docs, SF).count() == sum(r["score"] >= middle and r["lang_pred"] != language_id.UNKNOWN for r in verdict)
            monkeypatch.undo()
        assert gone == want
        docs = out
    packed = cp.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_edges(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        at = docs
        for name, stage in cp.STAGES:
            at = cp.keep(stage(spark, at, SF), name)
        assert (at.count() == 0) == (docs is no_docs)


def test_rows_are_judged_not_ids(spark):
    """Clean and rejected rows with null and shared ids, and repeated rows."""
    sf = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*cp.COLUMNS)
    verdict = {r["doc_id"]: r["predicted"] for r in toxicity.classify(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["text"] and r["n_chars"] > 50}
    toxic, clean = (next(t for d, t in sorted(texts.items()) if verdict[d] == y) for y in (1, 0))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    one, two = ("".join(f"{w}{k} " for k in range(40)) for w in ("red", "blue"))
    ids = (None, 10**9)

    def stage(name, pairs):
        rows = cp.keep(spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in pairs], docs.schema), "rows")
        rows = docs.union(rows) if name == "toxicity" else rows
        out = dict(cp.STAGES)[name](spark, rows, sf)
        return sorted(((r["doc_id"], r["text"]) for r in out.collect() if r["doc_id"] in ids or r["doc_id"] < 0), key=str)

    for name, bad, good in (("toxicity", toxic, clean), ("language_id", "12 34", one), ("decontamination", item, one)):
        pairs = [(d, t) for d in ids for t in (bad, good, good)]
        assert stage(name, pairs) == sorted(((d, t) for d, t in pairs if t == good), key=str), name
    pairs = [(None, one), (-5, one), (-5, one), (-4, one), (None, two), (None, two), (-5, "a lone text"), (None, "")]
    assert stage("jaccard_join", pairs) == sorted([(-5, one), (None, two), (-5, "a lone text"), (None, "")], key=str)
