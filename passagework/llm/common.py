"""What the operators share: table access, tables written between steps, Arrow helpers."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A key above this share of the rows is met by a broadcast of its few values, so that no task has it alone.
HOT_SHARE = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where Spark itself is local."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("passagework.scratch.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("passagework.scratch.dir", at)
    return at


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage, so an executor lost later repeats nothing before this point.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _give_back() -> None:
    """Return freed memory to the system: worker processes live on for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the C library, where it has one
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000, size: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows and about ``size`` bytes of strings, a longer
    row alone: a task holds Python copies of one part only."""
    _give_back()
    for b in batches:
        held = np.zeros(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type):
                held += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        upto, at = np.cumsum(held), 0
        while at < b.num_rows:
            fits = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + size, side="right"))
            stop = min(at + rows, max(fits, at + 1), b.num_rows)
            yield b.slice(at, stop - at)
            at = stop
    _give_back()


def per_batch(
    df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """Apply ``f`` to each Arrow batch of ``df``."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield f(b)

    return df.mapInArrow(go, schema)


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` evaluated once, however often ``f`` reads it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def met(rows: DataFrame, side: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` joined to ``side``, which has one row a key and in ``n`` how many of the rows have it.

    The few keys that more than a HOT_SHARE-th of all rows have are broadcast (HOT_SHARE at most),
    the others are shuffled.
    """
    limit = (side.agg(F.sum(n)).first()[0] or 0) // HOT_SHARE
    hot = side.where(F.col(n) > limit).select(key)
    few = F.broadcast(side.where(F.col(n) > limit))
    return rows.join(few, key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(side.where(F.col(n) <= limit), key))


def clear_of(spans: Iterable[tuple], taken: list[tuple[int, int]]) -> list[tuple]:
    """Those of ``spans`` (start, end, ...), by start, that overlap neither ``taken`` nor one kept before."""
    taken = sorted(taken)
    starts, tops, kept, end = [a for a, _ in taken], list(accumulate((b for _, b in taken), max)), [], 0
    for x in spans:
        before = bisect_left(starts, x[1])  # of those that start before its end the furthest end counts
        if x[0] >= end and not (before and tops[before - 1] > x[0]):
            kept.append(x)
            end = x[1]
    return kept


def texts(b: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as Python strings, null as empty."""
    return [x or "" for x in b.column(column).to_pylist()]


def blobs(b: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The column as UTF-8 bytes, null as empty."""
    return [x or b"" for x in b.column(column).cast(pa.binary()).to_pylist()]
