"""Rank fusion and parent expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 60.0


def ranked(scores: DataFrame, query: str, key: str, score: str, pool: int) -> DataFrame:
    """The best ``pool`` rows of each query, by score and then key."""
    w = Window.partitionBy(query).orderBy(F.desc(score), key)
    return scores.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= pool)


def two_arms(vector: DataFrame, lexical: DataFrame, keys: list[str], weight: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion of two ranked arms; a row of one arm alone survives."""
    v, x = vector.select(*keys, F.col("rank").alias("vector_rank")), lexical.select(*keys, F.col("rank").alias("lexical_rank"))
    part = lambda c: F.coalesce(1.0 / (K + F.col(c)), F.lit(0.0))
    return v.join(x, keys, "full_outer").withColumn("rrf", part("vector_rank") + weight * part("lexical_rank"))


def many_queries(lists: DataFrame, query: str, variant: str, key: str) -> DataFrame:
    """Sum of reciprocal ranks over the variants of a query; ties by first appearance."""
    return lists.groupBy(query, key).agg(
        F.sum(1.0 / (K + F.col("rank"))).alias("rrf"), F.min(F.struct(F.col(variant).alias("variant"), F.col("rank").alias("rank"))).alias("first_seen")
    )


def distinct_parents(ranked_rows: DataFrame, query: str, parent: list[str]) -> DataFrame:
    """The best ranked row of each parent; rows without a parent pass."""
    w = Window.partitionBy(query, *parent).orderBy("rank")
    bare = F.col(parent[0]).isNull()
    return ranked_rows.withColumn("_n", F.when(bare, 1).otherwise(F.row_number().over(w))).where("_n = 1").drop("_n")
