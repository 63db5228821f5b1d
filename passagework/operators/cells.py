"""A stored vector index: rows by the nearest of some centroids, searched in the nearest cells.

Centroids are fitted on a bounded sample; every row is assigned and stored in its cell's folder, as
blocks of unit vectors. A query meets only the blocks of its nearest cells; with all cells it is the
exact scan. A cell of any size is many blocks, which are dealt apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import small_batches, written
from .vector import CORPUS_BLOCK, FEW_BLOCKS, QUERY_BLOCK, best_of, meetings
from .vector import _blocks as whole_blocks
from .vector import top_k as exact

#: Rows that centroids are fitted on, at most; cells, at most.
SAMPLE, MOST_CELLS = 50_000, 4096
#: Queries that tell how many cells to search, neighbours of each, and the share of these to be found.
TRIED, NEIGHBOURS, SHARE = 200, 10, 0.95
SEED = 7


def _unit(b: pa.RecordBatch, column: str) -> np.ndarray:
    v = np.array(b.column(column).flatten()).reshape(b.num_rows, -1).astype(np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def fitted(corpus: DataFrame, cells: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids of (vec_id, embedding) rows: as many as the root of their number by default.

    The sample is the rows whose hashed ids come first, the same at every run.
    """
    rows = corpus.where("embedding is not null and vec_id is not null")
    n = rows.count()
    if n == 0:
        return np.zeros((0, 1))
    cells = min(cells or int(np.ceil(np.sqrt(n))), MOST_CELLS, n)
    some = rows.select("vec_id", "embedding") if n <= sample else rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    points = some.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-300)))).alias("features"))
    found = np.array(KMeans(k=cells, seed=SEED, maxIter=10).fit(points).clusterCenters()) if cells > 1 else np.array([points.first()["features"].toArray()])
    return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-300)


def _dealt(rows: DataFrame, key: str, column: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """(cell, id, vector) of each row, for each of its ``probes`` nearest cells; vectors as unit doubles."""
    probes = min(probes, len(centroids))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                v = _unit(b, "vector")
                near = -(v @ centroids.T)
                cell = np.argpartition(near, probes - 1, axis=1)[:, :probes] if probes < near.shape[1] else np.tile(np.arange(near.shape[1]), (len(v), 1))
                of = np.repeat(np.arange(len(v)), probes)
                blobs = [x.tobytes() for x in v]
                yield pa.record_batch([pa.array(cell.ravel().astype(np.int32)), b.column("id").take(pa.array(of)), pa.array([blobs[i] for i in of.tolist()], pa.binary())], names=["cell", "id", "vector"])

    held = rows.where(F.col(column).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(column).alias("vector"))
    return held.mapInArrow(go, "cell int, id long, vector binary")


def _blocks(dealt: DataFrame, size: int, names: tuple[str, str]) -> DataFrame:
    """(cell, ids, vectors) blocks of at most ``size`` rows of one cell, from rows sorted by cell."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, vectors = None, [], []

        def block() -> pa.RecordBatch:
            return pa.record_batch([pa.array([at], pa.int32()), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([b"".join(vectors)], pa.binary())], names=["cell", *names])

        for b in batches:
            for cell, i, v in zip(*(b.column(c).to_pylist() for c in ("cell", "id", "vector")), strict=True):
                if ids and (cell != at or len(ids) == size):
                    yield block()
                    ids, vectors = [], []
                at = cell
                ids.append(i)
                vectors.append(v)
        if ids:
            yield block()

    return dealt.mapInArrow(go, f"cell int, {names[0]} binary, {names[1]} binary")


def _probes(corpus: DataFrame, centroids: np.ndarray) -> int:
    """So many nearest cells hold SHARE of the exact neighbours of TRIED rows, those of the first hashed ids."""
    rows = corpus.where("embedding is not null and vec_id is not null").select("vec_id", "embedding")
    tried = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TRIED).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = exact(tried, rows, NEIGHBOURS).join(rows, "vec_id").join(F.broadcast(tried), "query_id").select("vector", "embedding")
    pairs = near.toArrow().combine_chunks().to_batches()  # TRIED * NEIGHBOURS rows at most, but for repeated ids
    if not pairs:
        return 1
    q, v = _unit(pairs[0], "vector") @ centroids.T, (_unit(pairs[0], "embedding") @ centroids.T).argmax(axis=1)
    rank = (q > q[np.arange(len(v)), v][:, None]).sum(axis=1)
    return int(np.sort(rank)[int(np.ceil(SHARE * len(rank))) - 1]) + 1


def build(corpus: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE) -> None:
    """Store the index of (vec_id, embedding) rows; rows without a vector are left out, ids may repeat.

    How many cells a query searches by default is measured, not guessed: vectors without clusters
    need many, and then the index saves little.
    """
    spark = corpus.sparkSession
    centroids = fitted(corpus, cells, sample)
    spark.createDataFrame([(_probes(corpus, centroids) if len(centroids) else 1,)], "probes int").coalesce(1).write.parquet(f"{path}/probes")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(centroids) if len(centroids)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    # A cell's rows are dealt by id as well, so one that holds a third of them is no single task.
    rows = _dealt(corpus, "vec_id", "embedding", centroids, 1) if len(centroids) else spark.createDataFrame([], "cell int, id long, vector binary")
    spread = rows.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("cell", "id")
    _blocks(spread, CORPUS_BLOCK, ("own", "held")).write.partitionBy("cell").parquet(f"{path}/cells")


def top_k(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int | None = None, include_self: bool = False) -> DataFrame:
    """(query_id, vec_id, similarity, rank): the ``k`` most similar rows in each query's ``probes`` nearest
    cells (by default as many as ``build`` measured); of (query_id, vector) queries. All cells give the exact result."""
    probes = probes or spark.read.parquet(f"{path}/probes").first()["probes"]
    found = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r["cell"])  # MOST_CELLS rows at most
    if not found:
        return spark.createDataFrame([], "query_id long, vec_id long, similarity double, rank long")
    centroids = np.array([r["centroid"] for r in found])
    if probes >= len(centroids):  # every block of queries meets every cell; no vector is sent once a cell
        asked = written(whole_blocks(queries, "query_id", "vector", None, QUERY_BLOCK).repartition(F.xxhash64("ids")))
        asked = F.broadcast(asked) if asked.limit(FEW_BLOCKS + 1).count() <= FEW_BLOCKS else asked
        with small_batches(spark, 4):
            return best_of(written(meetings(spark.read.schema("own binary, held binary").parquet(f"{path}/cells").crossJoin(asked), k, include_self=include_self, whole=True)), k)
    asked = _blocks(_dealt(queries, "query_id", "vector", centroids, probes).repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("cell", "id"), QUERY_BLOCK, ("ids", "vectors"))
    held = spark.read.schema("own binary, held binary, cell int").parquet(f"{path}/cells")
    few = asked.limit(2001).count() <= 2000  # some hundred bytes to half a megabyte a block
    return best_of(meetings(held.join(F.broadcast(asked) if few else asked, "cell").drop("cell"), k, include_self=include_self), k)
