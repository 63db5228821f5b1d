"""Exact nearest neighbours by blocks of matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import small_batches, written
from . import rounds

#: Queries of a block, and vectors of a corpus block; a task holds one of each and their product.
QUERY_BLOCK, CORPUS_BLOCK = 1024, 4096
#: Blocks of queries that are broadcast, some 30 MB of 64 dimensions; more meet the corpus block by block.
FEW_BLOCKS = 64
#: Queries of a block that are multiplied at a time, and parts that the corpus blocks are dealt to, at most.
STRIP, MOST_PARTS = 128, 1000


def wrong_dimension(vectors: DataFrame, column: str, n: int) -> DataFrame:
    return vectors.where(F.col(column).isNull() | (F.size(column) != n))


def _blocks(rows: DataFrame, key: str, vector: str, scope: str | None, size: int) -> DataFrame:
    """(ids, vectors, scopes): unit vectors in blocks of at most ``size`` rows, one block a row.

    ``scopes`` is an array of the scope's values, empty without one. Rows without a vector are left out.
    """
    kind = rows.schema[scope].dataType.simpleString() if scope else "int"

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                b = whole.slice(at, size)
                v = np.array(b.column("vector").flatten()).reshape(b.num_rows, -1).astype(np.float64)
                v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
                scopes = pa.array([b.column("scope").to_pylist()], pa.list_(b.schema.field("scope").type)) if scope else pa.array([[]], pa.list_(pa.int32()))
                yield pa.record_batch([pa.array([b.column("id").to_numpy().astype("<i8").tobytes()], pa.binary()), pa.array([v.tobytes()], pa.binary()), scopes], names=["ids", "vectors", "scopes"])

    held = rows.where(F.col(vector).isNotNull() & F.col(key).isNotNull())
    held = held.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"), *([F.col(scope).alias("scope")] if scope else []))
    return held.mapInArrow(go, f"ids binary, vectors binary, scopes array<{kind}>")


def top_k(queries: DataFrame, corpus: DataFrame, k: int, scope: str | None = None, include_self: bool = False) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the ``k`` most similar corpus rows of each query.

    ``queries``: query_id, vector (and the ``scope`` column). ``corpus``: vec_id, embedding (and
    scope): only rows of a query's scope count; a null scope is nobody's. Queries and corpus are
    cut into blocks, every block of queries meets every block of the corpus in one matrix product,
    and each meeting gives on only its own best k per query, so what is shuffled grows with blocks
    and queries, not with their product with rows. Neither side is collected, so their numbers have
    no limit. Similarity is rounded to 6 places; ties fall to the smaller vec_id.
    """

    # Blocks are stored: a task then has one Python worker, not one that cuts and one that multiplies.
    asked = written(_blocks(queries, "query_id", "vector", scope, QUERY_BLOCK).repartition(F.xxhash64("ids")).withColumn("known", F.lit(None).cast(rounds.KNOWN)))
    held = written(_blocks(corpus, "vec_id", "embedding", scope, CORPUS_BLOCK).toDF("own", "held", "within"))
    asking = asked.agg(F.count("*").alias("blocks"), F.sum(F.length("ids") / 8).alias("queries")).first()
    few, best = asking["blocks"] <= FEW_BLOCKS, None
    steps = rounds.parts(held, "own", int(asking["queries"] or 0) * k)
    for step, (own, n) in enumerate(steps, 1):
        part = held.where(own).repartition(min(rounds.tasks(corpus.sparkSession, n), MOST_PARTS))
        with small_batches(corpus.sparkSession, 4):  # few: a task a part of the corpus, not one a pair of parts
            met = written(meetings(part.crossJoin(F.broadcast(asked) if few else asked), k, scope is not None, include_self, whole=True))
        best = best_of(best.drop("rank").unionByName(met) if best else met, k)
        if step < len(steps):
            best = written(best)
            least = best.where(F.col("rank") == k).select(F.col("query_id").alias("query"), F.col("similarity").alias("least"))
            asked = written(rounds.knowing(asked, "ids", least, FEW_BLOCKS))
    return best


def meetings(pairs: DataFrame, k: int, scoped: bool = False, include_self: bool = False, whole: bool = False) -> DataFrame:
    """(query_id, vec_id, similarity): the best ``k`` of each query in each pair of blocks (ids, vectors,
    scopes) and (own, held, within); ties fall to the smaller vec_id. With ``whole``, where a block of
    queries meets many, a task leaves out what is below a query's ``known`` value, or its k-th in a block that it met before."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}  # a number a query
        for b in batches:
            for row in range(b.num_rows):
                ids, own = (np.frombuffer(b.column(c)[row].as_buffer(), "<i8") for c in ("ids", "own"))
                m, v = (np.frombuffer(b.column(c)[row].as_buffer(), np.float64).reshape(n, -1) for c, n in (("vectors", len(ids)), ("held", len(own))))
                if scoped:
                    code: dict = {}
                    mine, theirs = (np.array([-1 - side if x is None else code.setdefault(x, len(code)) for x in b.column(c)[row].as_py()]) for side, c in enumerate(("scopes", "within")))
                least = np.full(len(ids), -np.inf)
                if whole and (name := ids.tobytes()) in known:
                    least = known[name]
                elif whole:
                    known[name] = least
                    if "known" in b.schema.names and (before := b.column("known")[row]).is_valid:
                        least[before.values.field("place").to_numpy()] = before.values.field("least").to_numpy()
                order = np.argsort(own, kind="stable")
                low, high = np.searchsorted(own[order], ids, "left"), np.searchsorted(own[order], ids, "right")
                for at in range(0, len(ids), STRIP):
                    some = slice(at, at + STRIP)
                    sim = m[some] @ v.T
                    if not include_self:
                        for i in np.flatnonzero(high[some] > low[some]).tolist():
                            sim[i, order[low[at + i] : high[at + i]]] = -np.inf
                    if scoped:
                        sim[mine[some, None] != theirs[None, :]] = -np.inf
                    # No sort of whole rows, nor rounding: all that may reach the least or k-th value when they are rounded.
                    bound = least[some].copy()
                    new = np.flatnonzero(bound == -np.inf)
                    if len(new) and len(own) > k:
                        bound[new] = np.partition(sim[new], -k, axis=1)[:, -k]
                    bound = np.maximum(bound - 2e-6, -2.0)
                    of, to = np.divmod(np.flatnonzero(sim >= bound[:, None]), len(own))
                    if len(of):
                        value = np.round(sim[of, to], 6)
                        best = np.lexsort((own[to], -value, of))
                        of, to, value = of[best], to[best], value[best]
                        nth = np.arange(len(of)) - np.searchsorted(of, of)  # ties beyond k with the larger ids are dropped at once
                        last = np.flatnonzero(nth == k - 1)
                        least[at + of[last]] = np.maximum(least[at + of[last]], value[last])
                        good = np.flatnonzero((nth < k) & (value >= least[at + of]))
                        of, to = of[good], to[good]
                        yield pa.record_batch([pa.array(ids[some][of]), pa.array(own[to]), pa.array(value[good])], names=["query_id", "vec_id", "similarity"])

    return pairs.mapInArrow(go, "query_id long, vec_id long, similarity double")


def best_of(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)
