"""Rounds of a search that meets all blocks: few of them first, whose k-th best values tell later ones what to leave out.

Without them each task gives on the best k of every query, so that what is shuffled grows with queries and tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import written
from .lexical import small

#: Blocks of the first round, how many times as many the next has, and rows that one round may give on.
FIRST, GROWTH, FEW_ROWS = 8, 12, 2_000_000
KNOWN = "array<struct<place:int,least:double>>"
#: Tasks of a round for each core, and blocks of a task, at most.
WAVES, MOST_BLOCKS = 8, 64


def parts(blocks: DataFrame, name: str, rows: int) -> list[tuple[Column, int]]:
    """The rounds: what the ``name`` of a block of one fulfils, and the number of these. A block gives on at most ``rows`` rows."""
    place = F.xxhash64(name)
    order = sorted(r[0] for r in blocks.select(place).collect())  # a number a block
    if len(order) <= 2 * FIRST or len(order) * rows <= FEW_ROWS:
        return [(F.lit(True), len(order))]
    n = max(round(log(len(order) / FIRST, GROWTH)), 1)
    ends = [round(FIRST ** (1 - i / n) * len(order) ** (i / n)) for i in range(n + 1)]
    above = [F.lit(True), *(place > order[end - 1] for end in ends[:-1])]  # blocks of one name are of one round
    below = [*(place <= order[end - 1] for end in ends[:-1]), F.lit(True)]
    return [(a & b, high - low) for a, b, low, high in zip(above, below, [0, *ends], ends)]


def tasks(spark: SparkSession, blocks: int) -> int:
    return max(min(blocks, max(WAVES * spark.sparkContext.defaultParallelism, ceil(blocks / MOST_BLOCKS))), 1)


def knowing(asks: DataFrame, ids: str, least: DataFrame, few: int) -> DataFrame:
    """Blocks of queries, whose numbers are packed in ``ids``, with ``known``: of ``least`` (query, least) what is known
    of a block's queries, beside their places. Up to ``few`` blocks are broadcast."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, packed in zip(b.column("_name").to_pylist(), b.column("ids"), strict=True):
                q = np.frombuffer(packed.as_buffer(), "<i8")
                yield pa.record_batch([pa.array([name] * len(q)), pa.array(np.arange(len(q), dtype=np.int32)), pa.array(q)], names=["_name", "place", "query"])

    name = F.md5(ids).alias("_name")
    placed = asks.select(name, F.col(ids).alias("ids")).mapInArrow(go, "_name string, place int, query long")
    known = written(placed.join(least, "query").groupBy("_name").agg(F.collect_list(F.struct("place", "least")).alias("known")))  # a block's queries
    return asks.drop("known").withColumn("_name", F.md5(ids)).join(small(known, few), "_name", "left").drop("_name")
