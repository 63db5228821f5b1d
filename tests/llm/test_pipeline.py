"""The pipeline against a plain model of its first three stages, and its last two by invariants."""

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from passagework.llm import pii, quality
from passagework.llm.common import table, written

from .conftest import SF
from .test_documents import held, linked


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {}
    at = docs
    for name, stage in pipeline.STAGES:
        at = written(stage(spark, at, SF))
        kept[name] = at.collect()
        if name != "best-fit packing":
            assert at.columns == columns
    first, second, third, fourth, last = kept.values()
    accepted = {r["doc_id"] for r in quality.scored(docs, table(spark, SF, "labels")).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in first} == accepted
    assert {r["doc_id"] for r in second} == {c for _, _, c in linked([(r["doc_id"], r["text"]) for r in first])}
    before = {r["doc_id"]: r["text"] for r in second}
    assert {r["doc_id"]: r["text"] for r in third} == {i: pii.redacted(t) for i, t in before.items()}
    assert {r["doc_id"] for r in fourth} <= set(before) and len(fourth) > 0
    held(last, 2048)
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in fourth}
    assert pipeline.run(spark, SF).count() == len(last)


def test_edges_through_all_stages(spark, edge, tmp_path):
    """Nulls, repeated and missing ids, a very long text and clashing columns; labels of one class, which accept all."""
    sf = f"file://{tmp_path}/sf"
    more = edge.where("doc_id in (6, 9)").withColumn("doc_id", F.lit(None).cast("long")).withColumn("lang", F.lit(None).cast("string"))
    docs = edge.unionByName(more).withColumns({"__id": F.lit(1), "found_1": F.lit("x"), "score": F.lit(0.5), "key": F.lit("k"), "set": F.lit(2), "at": F.lit(3), "copy": F.lit("c")})
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 11)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    at, rows = table(spark, sf, "documents"), {}
    for name, stage in pipeline.STAGES:
        at = written(stage(spark, at, sf))
        rows[name] = at.collect()
        if name != "best-fit packing":
            assert at.columns == docs.columns
    first, second, third, fourth, last = rows.values()
    assert len(first) == 13
    # Of 1, 1 and 2 one row stays, and one of each text that a row without an id repeats.
    assert sorted((r["doc_id"] for r in second), key=lambda i: (i is None, i)) == [1, 3, 4, 5, 6, 7, 8, 9, 10]
    assert next(r for r in third if r["doc_id"] == 8)["text"] != next(r for r in second if r["doc_id"] == 8)["text"]
    assert len(next(r for r in third if r["doc_id"] == 7)["text"]) > 500_000
    assert {r["doc_id"] for r in fourth} <= {r["doc_id"] for r in third}
    held(last, 2048)
    assert {r["doc_id"] for r in last} == {r["doc_id"] for r in fourth}


def test_no_documents(spark, edge, tmp_path):
    sf = f"file://{tmp_path}/sf"
    edge.limit(0).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert pipeline.run(spark, sf).collect() == []
