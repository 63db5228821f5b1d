"""Named plans of vector, lexical and fused retrieval, each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import cells, fusion, inverted, lexical, providers, vector
from ..sources import store
from ..sources.tables import table

POOL, TOP = 50, 10


def _probes(e: DataFrame) -> DataFrame:
    """One probe per label: its least vec_id."""
    p = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("x"))
    return p.select(F.col("x.vec_id").alias("query_id"), F.col("x.embedding").alias("vector"), "label")


def _every(e: DataFrame) -> DataFrame:
    """The queries of the ``_every`` plans: all rows whose id is divisible by 20."""
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")


def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return vector.top_k(_probes(e), e, 5)


def knn_scoped_by_label(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return vector.top_k(_probes(e), e, 5, scope="label")


def _verdicts(e: DataFrame, p: DataFrame) -> DataFrame:
    """CLEAN WIN if the first and four of five neighbours have the probe's label, and so on."""
    near = vector.top_k(p, e, 5).join(e.select("vec_id", F.col("label").alias("found")), "vec_id").join(lexical.small(p.select("query_id", "label")), "query_id")
    hit = (F.col("found") == F.col("label")).cast("int")
    g = near.groupBy("query_id", "label").agg(F.sum(hit).alias("hits"), F.max(F.when(F.col("rank") == 1, hit)).alias("first"))
    verdict = F.when((F.col("first") == 1) & (F.col("hits") >= 4), "CLEAN WIN").when(F.col("first") == 1, "PARTIAL").otherwise("MISS")
    return g.select("query_id", "label", F.col("hits").cast("long").alias("hits"), verdict.alias("verdict"))


def probe_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Probes with a list of expected clusters, which may be empty: how many of the five nearest are in
    them, and the verdict in the words that a report shows."""
    e, i = table(spark, sf, "embeddings"), F.col("query_id") / 20 % 3
    expected = F.when(i == 0, F.array().cast("array<bigint>")).when(i == 1, F.array("label")).otherwise(F.array(F.col("label"), F.col("label") + 1))
    p = _every(e).withColumn("label", F.col("label").cast("long")).withColumn("expected", expected)
    near = vector.top_k(p, e, 5).join(e.select("vec_id", F.col("label").cast("long").alias("found")), "vec_id").join(lexical.small(p.select("query_id", "expected")), "query_id")
    hit = F.array_contains("expected", F.col("found"))
    g = near.groupBy("query_id").agg(F.first("expected").alias("expected"), F.count_if(hit).alias("hits"), F.max_by(hit, -F.col("rank")).alias("first"), F.max_by("found", -F.col("rank")).alias("top"))
    said = F.when(F.size("expected") == 0, "EXPLORATORY (no fixed expectation)").when(F.col("first") & (F.col("hits") >= 4), "CLEAN WIN")
    said = said.when(F.col("first"), F.format_string("PARTIAL (top-1 ok, %d/5 in expected clusters)", "hits")).otherwise(F.format_string("MISS (top-1 is %d, %d/5 in expected)", "top", "hits"))
    return g.select("query_id", "hits", said.alias("verdict"))


def knn_probe_verdict(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return _verdicts(e, _probes(e))


def knn_topk_every(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return vector.top_k(_every(e), e, 5)


def knn_scoped_every(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return vector.top_k(_every(e), e, 5, scope="label")


def knn_verdict_every(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return _verdicts(e, _every(e))


def _cells(spark: SparkSession, sf: str) -> str:
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return store.built_once(e, "cells", lambda at: cells.build(e, at))


def ann_every_cell(spark: SparkSession, sf: str) -> DataFrame:
    """The stored vector index with all its cells: the exact way, which shows that no row is lost in it."""
    return cells.top_k(spark, _cells(spark, sf), _every(table(spark, sf, "embeddings")), 5, probes=cells.MOST_CELLS)


def ann_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of the first ten by the nearest cells against the exact scan, and whether nine tenths are reached."""
    e = table(spark, sf, "embeddings")
    asked = _every(e)
    near = cells.top_k(spark, _cells(spark, sf), asked, TOP).select("query_id", "vec_id", F.lit(1).alias("hit"))
    g = vector.top_k(asked, e, TOP).select("query_id", "vec_id").join(near, ["query_id", "vec_id"], "left").agg(F.countDistinct("query_id").alias("queries"), (F.count("hit") / F.count("*")).alias("recall"))
    return g.select("queries", (F.col("recall") >= 0.9).alias("enough"))


def vector_dim_check(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return e.groupBy("label").agg(
        F.count("*").alias("rows"), F.count(F.when(F.size("embedding") != 64, 1)).alias("wrong"), F.count(F.when(F.abs(norm - 1) > 1e-4, 1)).alias("not_unit")
    )


def _whole(spark: SparkSession, sf: str, head: int = 0, tail: int = 0) -> DataFrame:
    """Terms of all tokens of each passage, without ``head`` tokens at its start and ``tail`` at its end."""
    w = words(F.col("text"))
    cut = F.slice(w, 1 + head, F.greatest(F.size(w) - head - tail, F.lit(0))) if head or tail else w
    b = table(spark, sf, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.explode(cut).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))


def _index(spark: SparkSession, sf: str) -> str:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return store.built_once(docs, "lexical", lambda at: inverted.append(docs, "doc_id", at))


def _lexical(spark: SparkSession, sf: str, terms: DataFrame, pool: int) -> DataFrame:
    s = inverted.search(spark, _index(spark, sf), terms, "query_id", "doc_id", pool).withColumn("score", F.round("score", 6))
    return fusion.ranked(s, "query_id", "doc_id", "score", pool)


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _lexical(spark, sf, _whole(spark, sf), TOP)


def _hybrid(spark: SparkSession, sf: str, p: DataFrame) -> DataFrame:
    """Vector arm of the probes ``p``, lexical arm of all tokens of their documents."""
    e, docs = table(spark, sf, "embeddings"), table(spark, sf, "documents")
    v = vector.top_k(p, e, POOL).select("query_id", F.col("vec_id").alias("doc_id"), "rank")
    asked = docs.join(lexical.small(p.select(F.col("query_id").alias("doc_id"))), "doc_id").select(F.col("doc_id").alias("query_id"), "text")
    x = _lexical(spark, sf, lexical.query_terms(asked, "query_id"), POOL)
    fused = fusion.two_arms(v, x, ["query_id", "doc_id"], 0.5).withColumn("rrf", F.round("rrf", 9))
    return fusion.ranked(fused, "query_id", "doc_id", "rrf", TOP).select("query_id", "doc_id", "rrf", "rank")


def rrf_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(spark, sf, _probes(table(spark, sf, "embeddings")))


def rrf_hybrid_every(spark: SparkSession, sf: str) -> DataFrame:
    return _hybrid(spark, sf, _every(table(spark, sf, "embeddings")))


def _fused(spark: SparkSession, sf: str, variants: list[DataFrame]) -> DataFrame:
    lists = [_lexical(spark, sf, terms, POOL).withColumn("variant", F.lit(k)) for k, terms in enumerate(variants)]
    fused = fusion.many_queries(reduce(DataFrame.unionByName, lists), "query_id", "variant", "doc_id").withColumn("rrf", F.round("rrf", 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "first_seen", "doc_id")
    return fused.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= TOP).select("query_id", "doc_id", "rrf", "rank")


def rrf_multi_query(spark: SparkSession, sf: str) -> DataFrame:
    """The whole question, and it without its first word, its last, and both."""
    return _fused(spark, sf, [_whole(spark, sf, *ends) for ends in ((0, 0), (1, 0), (0, 1), (1, 1))])


def parent_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    top = _lexical(spark, sf, _whole(spark, sf), POOL).join(table(spark, sf, "documents").select("doc_id", "source"), "doc_id")
    return fusion.distinct_parents(top, "query_id", ["source"]).select("query_id", "source", "doc_id", "rank")


def rerank_lexical(spark: SparkSession, sf: str) -> DataFrame:
    """A wide lexical pool, then the reranker on that pool alone."""
    pool = _lexical(spark, sf, _whole(spark, sf), POOL).select("query_id", "doc_id", F.col("rank").alias("first_rank"))
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    rows = pool.join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").join(lexical.small(b), "query_id")
    scored = rows.select("query_id", "doc_id", "first_rank", F.round(providers.overlap_score(F.col("question"), F.col("text")), 6).alias("rerank"))
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank"), "first_rank")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= TOP)


QUERIES = {f.__name__: f for f in (knn_topk_every, knn_scoped_every, knn_verdict_every, ann_every_cell, ann_recall, probe_verdicts, rrf_hybrid_every, knn_topk, knn_scoped_by_label, knn_probe_verdict, vector_dim_check, bm25_topk, rrf_hybrid, rrf_multi_query, parent_dedupe, rerank_lexical)}
QUERIES |= {f"{f.__name__}_whole": f for f in (bm25_topk, rrf_multi_query, parent_dedupe, rerank_lexical)}  # earlier names of the same plans

TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"
PROBES = "probes AS (SELECT min(vec_id) AS query_id, label FROM embeddings GROUP BY label)"


EVERY = "probes AS (SELECT vec_id AS query_id, label FROM embeddings WHERE vec_id % 20 = 0)"


def knn(k: int, scope: bool = False, probes: str = PROBES) -> str:
    same = "AND e.label = p.label" if scope else ""
    return f"""{probes},
sims AS (SELECT p.query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS similarity FROM probes p JOIN embeddings q ON q.vec_id = p.query_id JOIN embeddings e ON e.vec_id <> p.query_id {same}),
near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id)::BIGINT AS rank FROM sims QUALIFY rank <= {k})"""


def bm25(name: str, terms: str, pool: int) -> str:
    """CTEs that end in ``name``: the best of the queries whose terms ``terms`` selects."""
    return f"""
{name}_q AS (SELECT query_id, term, count(*) AS qf FROM ({terms}) GROUP BY 1, 2),
{name}_t AS (SELECT doc_id, unnest(tk) AS term, len(tk)::DOUBLE AS dl FROM (SELECT doc_id, {TOK} AS tk FROM documents)),
{name}_l AS (SELECT count(*) AS n, avg(len({TOK})) AS avgdl FROM documents),
{name}_f AS (SELECT term, doc_id, dl, count(*)::DOUBLE AS tf FROM {name}_t WHERE term IN (SELECT term FROM {name}_q) GROUP BY 1, 2, 3),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_f GROUP BY 1),
{name}_s AS (SELECT query_id, doc_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM {name}_f JOIN {name}_d USING (term) JOIN {name}_q USING (term), {name}_l GROUP BY 1, 2),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::BIGINT AS rank FROM {name}_s QUALIFY rank <= {pool})"""


def whole(head: int = 0, tail: int = 0) -> str:
    return f"SELECT item_id AS query_id, unnest(tk[{1 + head}:len(tk) - {tail}]) AS term FROM (SELECT item_id, {TOK} AS tk FROM benchmark)"


_variants = ((0, 0), (1, 0), (0, 1), (1, 1))
SQL = {
    "knn_topk": f"WITH {knn(5)} SELECT * FROM near",
    "knn_scoped_by_label": f"WITH {knn(5, True)} SELECT * FROM near",
    "knn_probe_verdict": f"""WITH {knn(5)},
g AS (SELECT n.query_id, p.label, sum((e.label = p.label)::INT)::BIGINT AS hits, max(CASE WHEN rank = 1 THEN (e.label = p.label)::INT END) AS first FROM near n JOIN probes p USING (query_id) JOIN embeddings e ON e.vec_id = n.vec_id GROUP BY 1, 2)
SELECT query_id, label, hits, CASE WHEN first = 1 AND hits >= 4 THEN 'CLEAN WIN' WHEN first = 1 THEN 'PARTIAL' ELSE 'MISS' END AS verdict FROM g""",
    "vector_dim_check": "SELECT label, count(*)::BIGINT AS rows, count(CASE WHEN len(embedding) <> 64 THEN 1 END)::BIGINT AS wrong, count(CASE WHEN abs(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) - 1) > 1e-4 THEN 1 END)::BIGINT AS not_unit FROM embeddings GROUP BY 1",
    "bm25_topk": f"WITH {bm25('b', whole(), TOP)} SELECT query_id, doc_id, score, rank FROM b",
    "rrf_hybrid": f"""WITH {knn(POOL)}, {bm25('b', f"SELECT doc_id AS query_id, unnest({TOK}) AS term FROM documents WHERE doc_id IN (SELECT query_id FROM probes)", POOL)},
f AS (SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.vec_id, b.doc_id) AS doc_id, round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + 0.5::DOUBLE * coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS rrf FROM near v FULL OUTER JOIN b ON v.query_id = b.query_id AND v.vec_id = b.doc_id)
SELECT query_id, doc_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id)::BIGINT AS rank FROM f QUALIFY rank <= {TOP}""",
    "rrf_multi_query": f"""WITH {', '.join(bm25(f'v{i}', whole(*ends), POOL) for i, ends in enumerate(_variants))},
u AS ({' UNION ALL '.join(f'SELECT query_id, doc_id, rank, {i} AS variant FROM v{i}' for i in range(len(_variants)))}),
f AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf, min(variant * 1000000 + rank) AS seen FROM u GROUP BY 1, 2)
SELECT query_id, doc_id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, seen, doc_id)::BIGINT AS rank FROM f QUALIFY rank <= {TOP}""",
    "parent_dedupe": f"""WITH {bm25('b', whole(), POOL)} SELECT query_id, source, doc_id, rank FROM b JOIN documents USING (doc_id) QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) = 1""",
    "rerank_lexical": f"""WITH {bm25('b', whole(), POOL)},
r AS (SELECT b.query_id, b.doc_id, b.rank AS first_rank, q.w, list_distinct(regexp_extract_all(lower(d.text), '[\\p{{L}}\\p{{N}}]+')) AS t FROM b JOIN documents d ON d.doc_id = b.doc_id JOIN (SELECT item_id, list_distinct({TOK}) AS w FROM benchmark) q ON q.item_id = b.query_id),
s AS (SELECT query_id, doc_id, first_rank, round(len(list_intersect(w, t))::DOUBLE / len(w), 6) AS rerank FROM r)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, first_rank)::BIGINT AS rank FROM s QUALIFY rank <= {TOP}""",
}

SQL |= {
    "knn_topk_every": f"WITH {knn(5, probes=EVERY)} SELECT * FROM near",
    "probe_verdicts": f"""WITH {knn(5, probes=EVERY)},
p AS (SELECT query_id, CASE query_id // 20 % 3 WHEN 0 THEN [] WHEN 1 THEN [label] ELSE [label, label + 1] END AS expected FROM probes),
g AS (SELECT n.query_id, any_value(expected) AS expected, count(*) FILTER (list_contains(expected, e.label))::BIGINT AS hits, max(CASE WHEN rank = 1 THEN e.label END) AS top FROM near n JOIN p USING (query_id) JOIN embeddings e ON e.vec_id = n.vec_id GROUP BY 1)
SELECT query_id, hits, CASE WHEN len(expected) = 0 THEN 'EXPLORATORY (no fixed expectation)' WHEN NOT list_contains(expected, top) THEN 'MISS (top-1 is ' || top::VARCHAR || ', ' || hits::VARCHAR || '/5 in expected)' WHEN hits >= 4 THEN 'CLEAN WIN' ELSE 'PARTIAL (top-1 ok, ' || hits::VARCHAR || '/5 in expected clusters)' END AS verdict FROM g""",
    "ann_every_cell": f"WITH {knn(5, probes=EVERY)} SELECT * FROM near",
    "ann_recall": "SELECT count(*)::BIGINT AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0",
    "knn_scoped_every": f"WITH {knn(5, True, EVERY)} SELECT * FROM near",
    "knn_verdict_every": SQL["knn_probe_verdict"].replace(PROBES, EVERY),
    "rrf_hybrid_every": SQL["rrf_hybrid"].replace(PROBES, EVERY),
}
SQL |= {f"{name}_whole": SQL[name] for name in ("bm25_topk", "rrf_multi_query", "parent_dedupe", "rerank_lexical")}
