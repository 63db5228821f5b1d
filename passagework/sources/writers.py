"""Versioned tables: upserts, replaced partitions, integrity checks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of both, those of ``new`` where keys meet."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def latest(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """The last row of each key; ``order`` must be total within a key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Write ``rows``; partitions that they have replace those on disk, others stay."""
    rows.repartition(*by).sortWithinPartitions(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks with a vector each, by version and source; a missing vector stops the write."""
    ok = chunks.withColumn("embedding", F.when(F.col("embedding").isNull(), F.raise_error(F.lit("chunk without vector"))).otherwise(F.col("embedding")))
    replace_partitions(ok, path, ["chunking_version", "source_id"])


def append_notes(notes: DataFrame, path: str) -> None:
    """Notes of a batch of chunks, kept beside those written before; the cache that a rerun reads."""
    notes.write.mode("append").parquet(path)


def cached_notes(spark: SparkSession, path: str, schema: str, key: list[str]) -> DataFrame:
    """The notes written so far, one of each key; none where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path).dropDuplicates(key)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def without_tag(rows: DataFrame, column: str, tag: str) -> DataFrame:
    """``rows`` but those of a tag; rows without one stay."""
    return rows.where(~F.col(column).eqNullSafe(F.lit(tag)))


def duplicate_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    return child.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def run_as_json(results: DataFrame, path: str) -> None:
    """A run, its frozen cases or its gold as JSON in one file, fields in the order of the columns.

    A run has as many rows as questions.
    """
    results.coalesce(1).write.mode("overwrite").json(path)
