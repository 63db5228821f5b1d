"""Retrieval as one operator: first stage, fusion, reranking and parents for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fusion, inverted, lexical, providers, vector


def pool_size(top_k: int, rerank: bool, pool_k: int) -> tuple[int, int]:
    """(rows that the first stage gives, rows of each arm before fusion)."""
    fetch = max(pool_k, top_k) if rerank else top_k
    return fetch, max(5 * fetch, 100)


def retrieve(
    queries: DataFrame, chunks: DataFrame, sources: DataFrame, version: str = "naive-v1", mode: str = "vector", top_k: int = 5,
    weight: float = 1.0, rerank: bool = False, pool_k: int = 50, scoped: bool = False, column: str = "embedding",
) -> DataFrame:
    """The ``top_k`` chunks of one chunking version for each query, with their sources.

    ``queries``: query_id, question, vector, and slug if ``scoped`` to one source each; the vector may
    be that of another text, the lexical arm and the reranker take the question. ``chunks``: chunk_id,
    source_id, chunking_version, chunk_index, chapter, text, context, char_start, char_end and the
    vector column of the asked model. ``sources``: source_id, slug, author, title, year. In hybrid mode
    scores are reciprocal ranks of both arms; with ``rerank`` a deeper pool is scored by question and text.
    """
    if mode not in ("vector", "hybrid"):
        raise ValueError(f"no mode {mode!r}")
    if scoped and mode == "hybrid":
        raise ValueError("one source is supported in vector mode only")
    fetch, pool = pool_size(top_k, rerank, pool_k)
    own = chunks.where((F.col("chunking_version") == version) & F.col(column).isNotNull())
    vectors = own.select(F.col("chunk_id").alias("vec_id"), F.col(column).alias("embedding"), *(["source_id"] if scoped else []))
    if scoped:
        vectors = vectors.join(sources.select("source_id", "slug"), "source_id").drop("source_id")
    near = vector.top_k(queries, vectors, pool if mode == "hybrid" else fetch, scope="slug" if scoped else None, include_self=True)
    found = near.select("query_id", F.col("vec_id").alias("chunk_id"), "similarity", "rank")
    if mode == "hybrid":
        terms = lexical.query_terms(queries.select("query_id", F.col("question").alias("text")), "query_id")
        scores = inverted.once(own.select("chunk_id", "text"), "chunk_id", terms, "query_id", pool).withColumn("score", F.round("score", 6))
        fused = fusion.two_arms(found, fusion.ranked(scores, "query_id", "chunk_id", "score", pool), ["query_id", "chunk_id"], weight)
        fused = fusion.ranked(fused.withColumn("rrf", F.round("rrf", 9)), "query_id", "chunk_id", "rrf", fetch)
        found = fused.join(found.select("query_id", "chunk_id", "similarity"), ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", "similarity", "rrf", "rank")
    # Ids are ranked first; texts and sources join only what is left.
    rows = found.join(own.drop(column), "chunk_id").join(sources, "source_id")
    if rerank:
        rows = rows.join(lexical.small(queries.select("query_id", "question")), "query_id")
        score = F.round(providers.overlap_score(F.col("question"), providers.rerank_text(F.col("context"), F.col("text"))), 6)
        rows = rows.withColumn("rerank", score).drop("question").withColumnRenamed("rank", "first_rank")
        w = Window.partitionBy("query_id").orderBy(F.desc("rerank"), "first_rank")
        rows = rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top_k)
    return rows


def expanded(rows: DataFrame, parents: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each query, each section once, with its text and bounds in place of the
    chunk's; ``parents``: chunk_id, parent_text, parent_start, parent_end. Chunks without one pass."""
    held = rows.where(F.col("rank") <= k).join(parents, "chunk_id", "left")
    first = fusion.distinct_parents(held, "query_id", ["parent_start", "parent_end", "slug"])
    of = lambda a, b: F.coalesce(F.col(a), F.col(b)).alias(b)
    rest = [c for c in rows.columns if c not in ("text", "char_start", "char_end")]
    return first.select(*rest, of("parent_text", "text"), of("parent_start", "char_start"), of("parent_end", "char_end"))


def many_variants(lists: list[DataFrame], question: DataFrame, texts: DataFrame, pool_k: int, top_k: int) -> DataFrame:
    """Ranked lists of a question's variants fused, the first ``pool_k`` reranked with the question itself."""
    every = lists[0].withColumn("variant", F.lit(0))
    for i, x in enumerate(lists[1:], 1):
        every = every.unionByName(x.withColumn("variant", F.lit(i)))
    fused = fusion.many_queries(every, "query_id", "variant", "chunk_id").withColumn("rrf", F.round("rrf", 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "first_seen", "chunk_id")
    pool = fused.withColumn("first_rank", F.row_number().over(w).cast("long")).where(F.col("first_rank") <= pool_k).drop("first_seen")
    rows = pool.join(texts, "chunk_id").join(lexical.small(question), "query_id")
    rows = rows.withColumn("rerank", F.round(providers.overlap_score(F.col("question"), F.col("text")), 6)).drop("question", "text")
    w = Window.partitionBy("query_id").orderBy(F.desc("rerank"), "first_rank")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top_k)


def ordered(lines: Column, order: str = "rank", sep: str = "\n") -> Column:
    """An aggregate: the lines of a group in the order of a column, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), lines.alias("x")))), lambda s: s["x"]), sep)
