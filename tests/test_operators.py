import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from passagework.operators import agentlog, evaluate, fusion, segment, vector
from passagework.sources import tables, writers
from passagework.streaming import replay


def pointers(tokens, target, overlap):
    """The chunker by prefix sums: chunks are the orbit of 0 under ``next``."""
    n, p = len(tokens), [0]
    for x in tokens:
        p.append(p[-1] + x)
    if p[n] <= target:
        return [(0, n)] if n else []
    i, out = 0, []
    while i < n:
        e = max([i + 1, *(j for j in range(i + 1, n + 1) if p[j] - p[i] <= target)])
        out.append((i, e))
        i = max(i + 1, min(o for o in range(i, e + 1) if p[e] - p[o] <= overlap))
    return out


@given(st.lists(st.integers(1, 60), max_size=40), st.integers(1, 120), st.integers(0, 50))
@settings(max_examples=300, deadline=None)
def test_chunks_equal_prefix_sums(tokens, target, overlap):
    assert segment.pack(tokens, target, overlap) == pointers(tokens, target, overlap)


@pytest.mark.parametrize(
    "tokens, overlap, want",
    [([300, 300, 30], 50, [(0, 1), (1, 3), (2, 3)]), ([300, 180, 30], 50, [(0, 2), (2, 3)]), ([900, 10], 0, [(0, 1), (1, 2)])],
)
def test_chunk_cases(tokens, overlap, want):
    assert segment.pack(tokens, 500, overlap) == want
    assert segment.pack([300, 300, 30], 500, 50, tail_repeat=False) == [(0, 1), (1, 3)]


@pytest.mark.parametrize("heads, kept", [(["I", "II", "C", "III", "VII", "VIII"], ["I", "II", "III", "VII", "VIII"]), (["I", "VI"], ["I"])])
def test_monotone_sections(spark, heads, kept):
    rows = spark.createDataFrame([(1, 10 * i, h) for i, h in enumerate(heads)], "doc_id long, char_start long, numeral string")
    lengths = spark.createDataFrame([(1, 100)], "doc_id long, length long")
    found = segment.sections(rows, lengths).orderBy("char_start").collect()
    assert [r["numeral"] for r in found] == kept
    assert [r["char_end"] for r in found] == [*(r["char_start"] for r in found[1:]), 100]


def test_section_heads(spark):
    docs = spark.createDataFrame([(1, "front\nI. one\nII. two"), (2, None)], "doc_id long, text string")
    assert [tuple(r) for r in segment.section_heads(docs, r"^([IVX]+)\. ").orderBy("char_start").collect()] == [(1, 6, "I"), (1, 13, "II")]


def test_coverage_by_midpoint(spark):
    chunks = spark.createDataFrame([("s", 0, 10)], "source string, char_start int, char_end int")
    spans = spark.createDataFrame([("s", 1, 8, 12), ("s", 2, 7, 12)], "source string, span int, span_start int, span_end int")
    assert [r["span"] for r in evaluate.covered(chunks, spans).collect()] == [2]


def test_recall_and_rank(spark):
    golden = spark.createDataFrame([(1, "c", 3), (2, "c", 0)], "question int, category string, spans long")
    hits = spark.createDataFrame([(1, 1, 1), (1, 2, 4)], "question int, span int, rank long")
    r = {(x["question"], x["k"]): x["recall"] for x in evaluate.recall(hits, golden).collect()}
    assert (r[1, 1], r[1, 3], r[1, 5], r[2, 5]) == (pytest.approx(1 / 3), pytest.approx(1 / 3), pytest.approx(2 / 3), None)
    assert all(r[1, a] <= r[1, b] for a, b in zip(evaluate.CUTS, evaluate.CUTS[1:]))
    assert {x["question"]: x["rr"] for x in evaluate.reciprocal_rank(hits, golden).collect()} == {1: 1.0, 2: None}


def test_fusion(spark):
    v = spark.createDataFrame([(1, 10, 1)], "q int, d int, rank long")
    x = spark.createDataFrame([(1, 10, 2), (1, 11, 3)], "q int, d int, rank long")
    got = {r["d"]: r["rrf"] for r in fusion.two_arms(v, x, ["q", "d"], 0.5).collect()}
    assert got == {10: pytest.approx(1 / 61 + 0.5 / 62), 11: pytest.approx(0.5 / 63)}
    assert {r["d"]: r["rrf"] for r in fusion.two_arms(v, x, ["q", "d"], 0.0).collect()}[10] == pytest.approx(1 / 61)


def test_pacing_and_cut(spark):
    log = spark.createDataFrame([(1, i, 0.0, t) for i, t in enumerate(["search", "read", "finalize", "search"], 1)], "run int, seq int, at double, tool string")
    assert [r["start"] for r in agentlog.paced(log, "at", 500.0).orderBy("seq").collect()] == [0, 500, 1000, 1500]
    assert agentlog.until_terminal(log, "finalize").count() == 3


def test_top_k_scoped_and_empty(spark):
    e = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.1], "b"), (3, [0.0, 1.0], "a"), (4, None, "a")], "vec_id long, embedding array<float>, label string")
    q = e.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")
    assert [r["vec_id"] for r in vector.top_k(q, e, 5).orderBy("rank").collect()] == [2, 3]
    assert [r["vec_id"] for r in vector.top_k(q, e, 5, scope="label").collect()] == [3]
    assert vector.top_k(q.limit(0), e, 5).count() == 0


def test_top_k_deals_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(vector, "QUERY_BLOCK", 7)
    monkeypatch.setattr(vector, "CORPUS_BLOCK", 11)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, x.tolist(), "ab"[i % 2]) for i, x in enumerate(v)] + [(60, None, "a"), (61, v[0].tolist(), None)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string").repartition(3)
    q = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")
    u = np.array([*v, v[0]], np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    at, label = [*range(60), 61], [r[2] for r in rows if r[1] is not None]
    for scope in (None, "label"):
        want = []
        for i, x in enumerate(np.round(u @ u.T, 6)):
            own = [j for j in range(61) if j != i and (not scope or label[i] == label[j] and label[i])]
            want += [(at[i], at[j], float(x[j]), r) for r, j in enumerate(sorted(own, key=lambda j: (-x[j], at[j]))[:4], 1)]
        assert sorted(tuple(r) for r in vector.top_k(q, e, 4, scope=scope).collect()) == sorted(want)
    many = spark.range(10_050).select(F.col("id").alias("query_id"), F.array(F.lit(1.0), F.col("id").cast("double")).alias("vector"))
    assert vector.top_k(many, e.where("vec_id < 3").withColumn("embedding", F.slice("embedding", 1, 2)), 2).count() == 20_100


def test_replace_partitions_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "chunks")
    a = spark.createDataFrame([("v1", 1, 0, [1.0]), ("v1", 2, 0, [1.0])], "chunking_version string, source_id int, chunk_index int, embedding array<double>")
    writers.write_chunks(a, path)
    b = spark.createDataFrame([("v1", 2, 7, [2.0])], a.schema)
    for _ in range(2):
        writers.write_chunks(b, path)
        assert sorted((r["source_id"], r["chunk_index"]) for r in spark.read.parquet(path).collect()) == [(1, 0), (2, 7)]
    with pytest.raises(Exception, match="chunk without vector"):
        writers.write_chunks(spark.createDataFrame([("v1", 3, 0, None)], a.schema), path)


def test_readers(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1.txt").write_text("one\ntwo")
    assert [tuple(r) for r in tables.raw_texts(spark, str(tmp_path / "t")).collect()] == [("1.txt", "one\ntwo")]
    (tmp_path / "g.json").write_text('[{"id": "q1", "category": "literal", "question": "?", "goldSpans": [{"sourceSlug": "s", "charStart": 1, "charEnd": 2}]}]')
    assert tables.golden_set(spark, str(tmp_path / "g.json")).first()["goldSpans"][0]["charEnd"] == 2
    (tmp_path / "r.json").write_text('{"results": [{"id": "q1", "mrr": 0.5}, {"id": "q2"}]}')
    assert tables.stored_run(spark, str(tmp_path / "r.json")).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    q = replay.hourly(replay.events_stream(spark, str(tmp_path / "in")), "60 days").writeStream.outputMode("complete").format("memory").queryName("hours").start()
    try:
        q.processAllAvailable()
        got = {(r["hour"], r["event_type"]): r["n"] for r in spark.table("hours").collect()}
    finally:
        q.stop()
    assert got == {(r["hour"], r["event_type"]): r["n"] for r in replay.hourly(source).collect()}


def test_sections_with_their_paragraphs_chunk_alike_with_one_worker_less(spark):
    docs = spark.createDataFrame([(k, "BOOK I\n\nI.--one two\n\n \t\n\nthree four five\n\nII.--six\n\n\n\nseven eight") for k in range(600)] + [(700, None), (701, "no head")], "doc_id long, text string")
    plain, blocked = (segment.section_chunks(segment.sections_of(docs, "books", blocked=b), 3, 1) for b in (False, True))
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, blocked.collect())) and blocked.count() > 1200
    workers = lambda df: df._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    assert workers(blocked) < workers(plain)


def test_a_task_leaves_out_what_an_earlier_block_beat(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((900, 8))
    e = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "vec_id long, embedding array<double>").coalesce(1)
    q = e.where("vec_id < 50").selectExpr("vec_id query_id", "embedding vector")
    asked, held = vector._blocks(q, "query_id", "vector", None, 64), vector._blocks(e, "vec_id", "embedding", None, 100).toDF("own", "held", "within")
    pairs = held.crossJoin(asked).coalesce(1)
    every, fewer = vector.meetings(pairs, 5), vector.meetings(pairs, 5, whole=True)
    assert every.count() == 9 * 50 * 5 and fewer.count() < 1500
    assert sorted(map(tuple, vector.best_of(every, 5).collect())) == sorted(map(tuple, vector.best_of(fewer, 5).collect()))
