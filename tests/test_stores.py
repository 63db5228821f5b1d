"""Stored tables: the inverted index, upserted buckets, chunks by version and source."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from passagework import plans
from passagework.functions import latin
from passagework.functions.text import words
from passagework.operators import cells, evaluate, fusion, inverted, lexical, rounds, vector
from passagework.plans import retrieval, scoring
from passagework.sources import store, writers


def corpus(spark, ids, seed=1):
    r = random.Random(seed)
    words = [f"w{int(r.paretovariate(0.6)) % 60}" for _ in range(4000)]
    return spark.createDataFrame([(i, None if i % 29 == 5 else " ".join(r.choice(words) for _ in range(r.randint(0, 40)))) for i in ids], "doc_id long, text string")


def terms_of(spark, *questions):
    rows = spark.createDataFrame(list(enumerate(questions)), "query_id long, text string")
    return lexical.query_terms(rows, "query_id")


def best(scores, k):
    rows = fusion.ranked(scores.withColumn("score", F.round("score", 6)), "query_id", "doc_id", "score", k)
    return sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in rows.collect())


@pytest.mark.parametrize("block", [7, 4096])
def test_search_equals_all_scores_after_each_append(spark, tmp_path, block):
    docs, path = corpus(spark, range(240)), f"file://{tmp_path}/index"
    terms = terms_of(spark, "w1 w2 w2 w3", "w40 w41 unheard", "nothing here", "w1", " ".join(f"w{i}" for i in range(60)))
    assert inverted.search(spark, path, terms, "query_id", "doc_id", 5).collect() == []  # nothing is indexed yet
    for upto, own in ((100, docs.where("doc_id < 100")), (240, docs.where("doc_id >= 100"))):
        inverted.append(own, "doc_id", path, block)
        held = docs.where(F.col("doc_id") < upto).fillna({"text": ""})
        assert best(inverted.search(spark, path, terms, "query_id", "doc_id", 5), 5) == best(lexical.bm25(held, "doc_id", terms, "query_id"), 5)


def test_blocks_below_the_kth_score_are_not_scored(spark, tmp_path):
    """Only one block holds the rare word often; of the others nothing is given on."""
    rows = [(i, "rare rare rare" if i < 8 else "common words that fill the text and then rare once at the end of a long long row") for i in range(64)]
    path = f"file://{tmp_path}/index"
    inverted.append(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), "doc_id", path, block=8)
    found = inverted.search(spark, path, terms_of(spark, "rare"), "query_id", "doc_id", 3).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(8))  # the ties of the first block, no other block's three best


def test_a_failed_append_leaves_nothing_searched(spark, tmp_path, monkeypatch):
    path, docs = f"file://{tmp_path}/index", corpus(spark, range(30))
    inverted.append(docs, "doc_id", path)
    terms = terms_of(spark, "w1 w2")
    before = best(inverted.search(spark, path, terms, "query_id", "doc_id", 5), 5)
    made = spark.read.parquet(f"{path}/postings").limit(20).withColumn("block", F.lit("of an append that ended before its last step"))
    made.write.mode("append").partitionBy("bucket").parquet(f"{path}/postings")
    assert best(inverted.search(spark, path, terms, "query_id", "doc_id", 5), 5) == before


# -- the vector index -------------------------------------------------------------------------------


def vectors(spark, n, clusters=12, seed=3):
    r = np.random.default_rng(seed)
    mid = r.normal(size=(clusters, 16))
    v = mid[r.integers(0, clusters, n) * (r.random(n) < 0.7)] + 0.35 * r.normal(size=(n, 16))  # over a third in one cluster
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(n, None), (None, v[0].tolist())], "vec_id long, embedding array<float>")


def test_cells_hold_every_row_and_find_most_neighbours(spark, tmp_path):
    e, path = vectors(spark, 1500), f"file://{tmp_path}/cells"
    cells.build(e, path)
    q = e.where("vec_id % 20 = 0 and embedding is not null").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    rows = lambda df: sorted(tuple(r) for r in df.select("query_id", "vec_id", "similarity", "rank").collect())
    exact = rows(vector.top_k(q, e, 10))
    assert rows(cells.top_k(spark, path, q, 10, probes=cells.MOST_CELLS)) == exact
    near = {x[:2] for x in rows(cells.top_k(spark, path, q, 10))}
    assert len(near & {x[:2] for x in exact}) >= 0.9 * len(exact)
    n, probes = spark.read.parquet(f"{path}/centroids").count(), spark.read.parquet(f"{path}/probes").first()[0]
    assert probes < n / 2  # clustered vectors need few cells
    plan = cells.top_k(spark, path, q, 10)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan  # only folders of asked cells are read


def test_empty_vector_index(spark, tmp_path):
    e = vectors(spark, 3)
    cells.build(e.limit(0), f"file://{tmp_path}/none")
    assert cells.top_k(spark, f"file://{tmp_path}/none", e.selectExpr("vec_id query_id", "embedding vector"), 3).collect() == []
    cells.build(e.limit(1), f"file://{tmp_path}/one")
    assert cells.top_k(spark, f"file://{tmp_path}/one", e.limit(2).selectExpr("vec_id query_id", "embedding vector"), 3).count() == 1


# -- upserts ----------------------------------------------------------------------------------------


def test_upsert_rewrites_touched_buckets_only(spark, tmp_path):
    path, cols = f"file://{tmp_path}/t", "k long, v string"
    make = lambda rows: spark.createDataFrame(rows, cols)
    shown = lambda: sorted(tuple(r) for r in store.current(spark, path, cols).collect())
    assert shown() == []
    assert len(store.upsert_into(make([(i, "old") for i in range(100)]), path, ["k"], 16)) == 16
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    new = make([(3, "new"), (3000, "added")])
    touched = store.upsert_into(new, path, ["k"], 16)
    assert 1 <= len(touched) <= 2
    assert shown() == sorted([(i, "new" if i == 3 else "old") for i in range(100)] + [(3000, "added")])
    assert all(p.stat().st_mtime_ns == at for p, at in files.items())  # readers of the old state keep it
    fresh = {p.parent.name for p in set(tmp_path.rglob("*.parquet")) - set(files)}
    assert fresh == {f"bucket={b}" for b in touched}
    assert store.upsert_into(new, path, ["k"], 16) == []  # a rerun changes nothing
    assert len(list(tmp_path.rglob("lists/*"))) == 2


def test_upsert_that_fails_changes_nothing(spark, tmp_path):
    path, cols = f"file://{tmp_path}/t", "k long, v string"
    store.upsert_into(spark.createDataFrame([(1, "a"), (2, "b")], cols), path, ["k"], 4)
    bad = spark.createDataFrame([(1, "x"), (2, "y")], cols).withColumn("v", F.when(F.col("k") == 2, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        store.upsert_into(bad, path, ["k"], 4)
    assert sorted(tuple(r) for r in store.current(spark, path, cols).collect()) == [(1, "a"), (2, "b")]


# -- chunks -----------------------------------------------------------------------------------------


def test_stored_chunks_are_pruned_by_version_and_source(spark, tmp_path):
    path = f"file://{tmp_path}/chunks"
    rows = [(i, f"s{i % 5}", ("naive-v1", "contextual-v1")[i % 2], [float(i)]) for i in range(40)]
    writers.write_chunks(spark.createDataFrame(rows, "chunk_id long, source_id string, chunking_version string, embedding array<double>"), path)
    one = store.stored_chunks(spark, path, "naive-v1")
    assert {r["chunk_id"] for r in one.collect()} == {i for i in range(0, 40, 2)}
    assert "PartitionFilters: [isnotnull(chunking_version" in one._jdf.queryExecution().toString()
    files = {r[0] for r in one.select("_metadata.file_path").collect()}
    assert len(files) == 5 and all("chunking_version=naive-v1/" in f for f in files)
    own = store.stored_chunks(spark, path, "naive-v1", spark.createDataFrame([("s2",)], "source_id string"))
    assert {r["chunk_id"] for r in own.collect()} == {2, 12, 22, 32}
    files = {r[0] for r in own.select("_metadata.file_path").collect()}
    assert len(files) == 1 and "source_id=s2/" in files.pop()


# -- intervals --------------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [1, 7, 4096])
def test_interval_joins_equal_all_pairs(spark, width):
    r = random.Random(width)
    some = lambda n, most: [(f"s{r.randint(0, 2)}", a, a + r.randint(0, most)) for a in (r.randint(-20, 200) for _ in range(n))]
    chunks, spans = some(60, 40) + [("s0", 5, 5), ("s0", 0, 300), (None, 0, 9)], some(40, 25) + [(None, 1, 4), ("s0", 8, 8)]
    chunks += chunks[:3]  # repeated rows
    c = spark.createDataFrame(chunks, "source string, char_start long, char_end long")
    s = spark.createDataFrame([(*x, i) for i, x in enumerate(spans)], "source string, span_start long, span_end long, span int")
    same = lambda x, y: x[0] is not None and x[0] == y[0]
    got = sorted((x["source"], x["char_start"], x["char_end"], x["span"]) for x in evaluate.covered(c, s, width).collect())
    assert got == sorted((*x, i) for x in chunks for i, y in enumerate(spans) if same(x, y) and x[1] <= (y[1] + y[2]) / 2 < x[2])
    got = sorted(tuple(x) for x in evaluate.overlapping(c, s, width).collect())
    assert got == sorted(x for x in chunks if any(same(x, y) and x[1] < y[2] and y[1] < x[2] for y in spans))


def test_one_large_source_is_many_groups(spark):
    n = 100_000
    c = spark.range(n).select(F.lit("one").alias("source"), (F.col("id") * 50).alias("char_start"), (F.col("id") * 50 + 60).alias("char_end"))
    s = spark.range(n).select(F.lit("one").alias("source"), (F.col("id") * 50 + 3).alias("span_start"), (F.col("id") * 50 + 9).alias("span_end"))
    assert evaluate.covered(c, s).count() == 2 * n - 1  # each span lies in its chunk and in the overlap of the one before
    keys = c.select(F.explode(evaluate._bins(F.col("char_start"), F.col("char_end"), evaluate.BIN)).alias("b")).groupBy("b").count()
    assert keys.count() > 1000 and keys.agg(F.max("count")).first()[0] < 200


# -- notes and runs ---------------------------------------------------------------------------------


def test_a_note_run_that_stops_half_way_is_taken_up(spark, tmp_path):
    path, log = f"file://{tmp_path}/notes", str(tmp_path / "asked")
    rows = [(f"s:{i}", f"p{i % 3}", f"text {i}") for i in range(60)]
    chunks = spark.createDataFrame(rows, "key string, profile string, text string")

    def make(profile, text, fails=()):
        with open(log, "a") as f:  # appended to by all tasks of this machine
            f.write(f"{profile}|{text}\n")
        if text in fails:
            raise ValueError("HTTP 503")
        return f"{profile} says {text}"

    store.noted(chunks.where("key in ('s:1', 's:2', 's:3')"), path, make, unit=2)  # what a stopped run had kept
    with open(log, "w"):
        pass
    found = {r["key"]: r for r in store.noted(chunks, path, lambda p, t: make(p, t, ("text 7",)), unit=4).collect()}
    asked = [x.strip().split("|")[1] for x in open(log)]
    assert sorted(set(asked)) == sorted(t for k, _, t in rows if k not in ("s:1", "s:2", "s:3"))
    assert asked.count("text 7") == 3 and len(asked) == 57 + 2
    assert len(found) == 60 and (found["s:7"]["note"], found["s:7"]["tries"], found["s:7"]["message"]) == ("", 3, "HTTP 503")
    assert found["s:8"]["note"] == "p2 says text 8" and found["s:8"]["tries"] == 1
    before = len(asked)
    assert store.noted(chunks, path, make).count() == 60 and len(open(log).readlines()) == before  # a rerun asks nothing
    assert store.noted(chunks.limit(0), f"file://{tmp_path}/none", make).count() == 0


def test_run_totals_come_with_its_rows(spark, tmp_path):
    path = f"file://{tmp_path}/run"
    rows = [(f"q{i}", {"faithfulness": float(i)}, None if i == 2 else i * 10, 1) for i in range(4)]
    run = spark.createDataFrame(rows, "id string, generation struct<faithfulness:double>, generator int, judge int")
    assert store.write_run(run, path, ["generator", "judge"]) == {"questions": 4, "generator": 40, "judge": 4}
    assert {r["id"]: r["generation"]["faithfulness"] for r in spark.read.json(path).collect()} == {f"q{i}": float(i) for i in range(4)}
    assert store.write_run(run.limit(0), path, ["generator"]) == {"questions": 0, "generator": 0}


def test_what_is_built_is_built_once_and_again_when_lost(spark, tmp_path):
    import shutil

    spark.range(5).write.parquet(f"{tmp_path}/t")
    source, made = spark.read.parquet(f"{tmp_path}/t"), []
    build = lambda at: made.append(at) or source.write.parquet(f"{at}/rows")
    first = store.built_once(source, "copy", build)
    assert store.built_once(source, "copy", build) == first and made == [first]
    shutil.rmtree(first.removeprefix("file://"))
    second = store.built_once(source, "copy", build)
    assert second != first and made == [first, second] and spark.read.parquet(f"{second}/rows").count() == 5


def test_a_table_in_the_very_folder_that_is_built_is_read_again(spark, tmp_path):
    """Its partitions are folders beside the mark."""
    spark.range(5).write.parquet(f"{tmp_path}/t")
    source = spark.read.parquet(f"{tmp_path}/t")
    rows = [(i, f"s{i % 2}", "naive-v1", [float(i)]) for i in range(6)]
    chunks = spark.createDataFrame(rows, "chunk_id long, source_id string, chunking_version string, embedding array<double>")
    for _ in range(2):
        path = store.built_once(source, "parts", lambda at: writers.write_chunks(chunks, at))
        assert store.stored_chunks(spark, path, "naive-v1").count() == 6


def test_blocks_of_the_index_are_bounded_by_tokens(monkeypatch):
    """Long texts make a block of fewer documents, across Arrow batches; none is lost, the order stays."""
    monkeypatch.setattr(inverted, "TOKENS", 10)
    sizes = [3, 4, 3, 1, 25, 2, 0, 0, 9, 1, 1]
    rows = pa.record_batch([pa.array([["w"] * n for n in sizes]), pa.array(range(len(sizes)))], names=["w", "k"])
    made = [t["k"].to_pylist() for t in inverted._cut(iter([rows.slice(0, 2), rows.slice(2)]), 4)]
    assert made == [[0, 1, 2], [3], [4], [5, 6, 7], [8, 9], [10]]


def test_hybrid_retrieval_makes_no_row_of_each_query_and_posting(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("a row of each query and posting")

    monkeypatch.setattr(lexical, "bm25", refused)
    for name in ("retrieve_hybrid", "retrieve_multi_query"):
        assert plans.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_a_task_of_a_vector_search_cuts_no_blocks(spark):
    e = vectors(spark, 300)
    q = e.where("vec_id % 20 = 0 and embedding is not null").selectExpr("vec_id query_id", "embedding vector")
    assert "MapInArrow" not in vector.top_k(q, e, 3)._jdf.queryExecution().toString()


def test_a_block_of_the_index_is_written_by_the_task_that_reads_it(spark, tmp_path, monkeypatch):
    """One row holds a block's postings, none is dealt out anew."""
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(*_):
        raise AssertionError("postings are shuffled")

    for name in ("repartition", "sortWithinPartitions"):
        monkeypatch.setattr(DataFrame, name, refused)
    inverted.append(corpus(spark, range(100)).coalesce(1), "doc_id", f"file://{tmp_path}/index", block=10)
    stored = spark.read.parquet(f"{tmp_path}/index/postings")
    assert stored.count() == 10
    assert stored.agg(F.sum(F.length("keys"))).first()[0] == 8 * 100


def test_latin_texts_are_cut_as_all_texts(spark, tmp_path):
    """Every character up to U+017F within and beside words, and others beside them in the same index."""
    texts = [f"x{chr(c)}Y {chr(c)} {chr(c)}{chr(c)}9_É" for c in range(1, 0x180) if c != 0x130] + ["", " ", "end", "Next end.", "ΣΑΣ ΑΣ, İx", "naïve 東京 ab１ ǅ", "tail’s ΣΑΣ"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select("doc_id", "text", words(F.col("text")).alias("w"), latin.is_latin(F.col("text")).alias("latin")).collect()
    assert [r["text"] for r in rows if not r["latin"]] == texts[-3:]
    plain = [r for r in rows if r["latin"]]
    assert latin.words(pa.array([r["text"] for r in plain])).to_pylist() == [r["w"] for r in plain]
    docs, path = spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows] + [(-1, None)], "doc_id long, text string"), f"file://{tmp_path}/index"
    inverted.append(docs, "doc_id", path, block=50)
    terms = terms_of(spark, "end next", "σας", "東京 ab１", "xéy", "ÿÿ9_é x")
    assert best(inverted.search(spark, path, terms, "query_id", "doc_id", 9), 9) == best(lexical.bm25(docs.fillna({"text": ""}), "doc_id", terms, "query_id"), 9)
    held = {(r["id"], r["doc_id"]) for r in inverted.holders(spark, path, terms.select("term"), "doc_id").collect()}
    asked = {r["term"]: r["id"] for r in terms.select("term", F.xxhash64("term").alias("id")).collect()}
    assert held == {(asked[w], r["doc_id"]) for r in rows for w in r["w"] if w in asked}


def test_scores_of_passages_ask_the_index_for_their_documents(spark):
    """No document is cut into words again, and the passages found are those of the plan without an index."""
    sf = "/root/testdata/sf0.001"
    plan = plans.QUERIES["mrr"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    rows = lambda df: sorted(tuple(r) for r in df.select("item_id", "doc_id", "span_start", "span_end").collect())
    assert rows(scoring.gold(spark, sf, retrieval._index(spark, sf))) == rows(scoring.gold(spark, sf)) != []


# -- rounds of a search -----------------------------------------------------------------------------


def few_at_first(monkeypatch):
    for name, value in (("FIRST", 2), ("GROWTH", 4), ("FEW_ROWS", 1), ("WAVES", 100)):
        monkeypatch.setattr(rounds, name, value)


def given_on(monkeypatch, module, columns):
    """The rows that tasks of a search give on, a number a round."""
    found, plain = [], module.written

    def counted(df):
        out = plain(df)
        if out.columns == columns:
            found.append(out.count())
        return out

    monkeypatch.setattr(module, "written", counted)
    return found


def test_later_rounds_of_a_lexical_search_give_on_few_rows(spark, tmp_path, monkeypatch):
    """Each block is a task of its own, and would give on its best five of every query."""
    few_at_first(monkeypatch)
    found = given_on(monkeypatch, inverted, ["query", "key", "score"])
    docs, path = corpus(spark, range(480)).repartition(4), f"file://{tmp_path}/index"
    inverted.append(docs, "doc_id", path, block=8)
    r = random.Random(2)
    terms = terms_of(spark, *(" ".join(f"w{r.randint(0, 59)}" for _ in range(r.randint(1, 30))) for _ in range(40)))
    got = best(inverted.search(spark, path, terms, "query_id", "doc_id", 5), 5)
    assert got == best(lexical.bm25(docs.fillna({"text": ""}), "doc_id", terms, "query_id"), 5)
    assert len(found) == 3 and found[0] <= 2 * 40 * 8 and sum(found) < 60 * 40 * 5 / 2


@pytest.mark.parametrize("few", [1, 2, 100])
def test_many_blocks_of_queries_meet_all_postings(spark, tmp_path, monkeypatch, few):
    few_at_first(monkeypatch)
    monkeypatch.setattr(inverted, "QUERIES", 6)
    monkeypatch.setattr(inverted, "FEW_BLOCKS", few)
    docs, path = corpus(spark, range(150)).repartition(3), f"file://{tmp_path}/index"
    inverted.append(docs, "doc_id", path, block=9)
    r = random.Random(7)
    terms = terms_of(spark, *(" ".join(f"w{r.randint(0, 59)}" for _ in range(r.randint(1, 12))) for _ in range(31)))
    got = best(inverted.search(spark, path, terms, "query_id", "doc_id", 4), 4)
    assert got == best(lexical.bm25(docs.fillna({"text": ""}), "doc_id", terms, "query_id"), 4)


def test_later_rounds_of_a_vector_search_give_on_few_rows(spark, monkeypatch):
    few_at_first(monkeypatch)
    found = given_on(monkeypatch, vector, ["query_id", "vec_id", "similarity"])
    monkeypatch.setattr(vector, "QUERY_BLOCK", 20)
    monkeypatch.setattr(vector, "CORPUS_BLOCK", 10)
    r = np.random.default_rng(4)
    v = r.normal(size=(400, 8)).round(1)
    v[300:] = v[:100]  # ties
    e = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>")
    q = e.where("vec_id % 10 = 0").selectExpr("vec_id query_id", "embedding vector")
    got = sorted((x["query_id"], x["rank"], x["vec_id"]) for x in vector.top_k(q, e, 5).collect())
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    sim = np.round(u[::10] @ u.T, 6)
    sim[np.arange(40), np.arange(0, 400, 10)] = -np.inf
    near = [np.lexsort((np.arange(400), -s))[:5].tolist() for s in sim]
    assert got == sorted((10 * i, n + 1, j) for i, own in enumerate(near) for n, j in enumerate(own))
    assert len(found) > 1 and sum(found) < 40 * 40 * 5 / 2


def test_each_block_is_of_one_round(spark, monkeypatch):
    few_at_first(monkeypatch)
    blocks = spark.range(100).select(F.col("id").cast("string").alias("block")).unionByName(spark.range(60).selectExpr("'alike' block"))
    found = [(blocks.where(own).count(), n) for own, n in rounds.parts(blocks, "block", 1)]
    assert sum(n for n, _ in found) == sum(n for _, n in found) == 160 and len(found) == 4
    assert rounds.parts(blocks.limit(4), "block", 10**9)[0][1] == 4 and len(rounds.parts(blocks.limit(4), "block", 10**9)) == 1


def test_a_task_is_handed_postings_and_queries_once(spark):
    packed = spark.range(6).selectExpr("string(id) block", "binary('p') ids").repartition(2)
    asks = spark.range(3).selectExpr("id ask", "binary('q') queries")
    pairs = inverted._pairs(packed, asks.coalesce(1), 3)
    rows = pairs.withColumn("task", F.spark_partition_id()).collect()
    assert len(rows) == 18 and len({(r["block"], r["ask"]) for r in rows}) == 18
    assert sum(r["ids"] is not None for r in rows) == 6
    for task in {r["task"] for r in rows}:
        own = [r for r in rows if r["task"] == task]
        seen = set()
        for at, r in enumerate(own):  # the first row that names a block or a query's block brings it
            assert (r["ids"] is not None) == (r["block"] not in seen) and (r["queries"] is not None) == (at < 3)
            seen.add(r["block"])


@pytest.mark.parametrize("known", [False, True])
def test_scores_of_a_meeting_equal_all_products(monkeypatch, known):
    """Strips of queries and parts of documents, frequent and rare terms, each weight of a term by itself."""
    for name, value in (("STRIP", 5), ("PART", 7), ("MOST_DENSE", 3), ("FEW_USES", 16), ("COLUMN", 1), ("PRODUCTS", 3)):
        monkeypatch.setattr(inverted, name, value)
    r = np.random.default_rng(5)
    uses = r.poisson(0.4, size=(40, 30)) * (r.random((40, 30)) < r.random(40)[:, None])
    uses[:, 29] = uses[:, 28]  # ties
    weight = np.where(r.random((23, 40)) < 0.4, r.integers(1, 3, (23, 40)) * np.linspace(0.5, 4, 40), 0)
    weight[:, 0] = 1.0
    lengths = uses.sum(axis=0)
    term, place = np.nonzero(uses)
    held = np.flatnonzero(uses.any(axis=1))
    x = {"ids": held * 10, "counts": np.bincount(term, minlength=40)[held], "places": place, "uses": uses[term, place], "keys": np.arange(30) + 100, "lengths": lengths}
    of, at = np.nonzero(weight)
    order = np.lexsort((of, weight[of, at], at, of // inverted._strip(23)))
    q = {"queries": np.arange(23) + 1000, "terms": np.arange(40) * 10, "of": of[order], "at": at[order], "weights": weight[of, at][order]}
    part = lexical.K1 * (1 - lexical.B + lexical.B * lengths / lengths.mean())
    scores = weight @ (uses * (lexical.K1 + 1) / (uses + part))
    last = np.sort(scores, axis=1)[:, -4]
    q["least"] = last.copy() if known else np.full(23, inverted.SLACK)
    found = {}
    for b in inverted._meeting(inverted._documents(x, lengths.mean()), q, 4, inverted._Room()):
        for i, j, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
            found[i - 1000, j - 100] = s
    assert all(abs(scores[p] - s) < 1e-9 for p, s in found.items())
    assert set(found) == {(i, j) for i, j in zip(*np.nonzero((scores >= last[:, None] - inverted.SLACK) & (scores > 0)))} or not known
    assert set(found) >= {(i, j) for i, j in zip(*np.nonzero((scores >= last[:, None]) & (scores > 0)))}
    assert np.allclose(q["least"], last)


def test_texts_of_one_language_lie_beside_each_other():
    r = np.random.default_rng(6)
    language = r.integers(0, 3, 900)
    rows = [(i, w) for i, x in enumerate(language) for w in {*(x * 20 + r.integers(0, 20, 15)).tolist(), *r.integers(60, 400, 5).tolist()}]
    order = inverted._beside(*map(np.array, zip(*rows)), 900)
    assert sorted(order) == list(range(900))
    assert np.count_nonzero(np.diff(language[order])) < 30 < 500 < np.count_nonzero(np.diff(language))
    assert inverted._beside(np.array([], int), np.array([], int), 3).tolist() == [0, 1, 2]


def test_counts_of_terms_are_those_of_all_blocks(spark, tmp_path, monkeypatch):
    docs, path = corpus(spark, range(200)), f"file://{tmp_path}/index"
    inverted.append(docs, "doc_id", path, block=9)
    counted = inverted._counted(inverted._stored(spark, path)[1])
    got = {r["id"]: r["df"] for r in counted.groupBy("id").agg(F.sum("df").alias("df")).collect()}
    want = docs.fillna({"text": ""}).select("doc_id", F.explode(words(F.col("text"))).alias("t")).distinct().groupBy(F.xxhash64("t").alias("id")).count()
    assert got == {r["id"]: r["count"] for r in want.collect()}
