"""Scoring of rankings and answers: span coverage, recall, reciprocal rank, rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTS = (1, 3, 5, 10, 20)


#: Positions of a bin: spans and chunks of one source meet only where they share a bin.
BIN = 4096


def _bins(start: Column, end: Column, width: int) -> Column:
    """The bins that [start, end) touches; that of its start where it is empty."""
    first = F.floor(start / width)
    return F.sequence(first, F.greatest(first, F.floor((end - 1) / width)))


def covered(chunks: DataFrame, spans: DataFrame, width: int = BIN) -> DataFrame:
    """Chunk rows joined to the spans of their source whose midpoint they hold.

    A midpoint lies in one bin, a chunk in those it touches: an equi-join by source and bin, so a
    source of very many chunks and spans is as many groups as it has bins, and no pair comes twice.
    """
    mid = (F.col("span_start") + F.col("span_end")) / 2.0
    of = spans.withColumn("_bin", F.floor(mid / width))
    held = chunks.withColumn("_bin", F.explode(_bins(F.col("char_start"), F.col("char_end"), width)))
    return held.join(of, ["source", "_bin"]).where((F.col("char_start") <= mid) & (mid < F.col("char_end"))).drop("_bin")


def overlapping(chunks: DataFrame, spans: DataFrame, width: int = BIN) -> DataFrame:
    """Chunks that overlap any span of their source, each once, found by source and bin."""
    s = spans.select(F.col("source").alias("span_source"), "span_start", "span_end", F.explode(_bins(F.col("span_start"), F.col("span_end"), width)).alias("_span_bin"))
    # Rows are told apart by a number of their own, as equal rows may each be asked for.
    held = chunks.withColumn("_row", F.monotonically_increasing_id()).withColumn("_bin", F.explode(_bins(F.col("char_start"), F.col("char_end"), width)))
    on = (F.col("source") == F.col("span_source")) & (F.col("_bin") == F.col("_span_bin")) & (F.col("char_start") < F.col("span_end")) & (F.col("span_start") < F.col("char_end"))
    return held.join(s, on, "left_semi").drop("_bin").dropDuplicates(["_row"]).drop("_row")


def recall(hits: DataFrame, golden: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """(question, k, recall) from (question, span, rank) hits; NULL where a question has no span."""
    best = hits.groupBy("question", "span").agg(F.min("rank").alias("rank"))
    found = best.groupBy("question").agg(*(F.sum((F.col("rank") <= k).cast("long")).alias(f"h{k}") for k in cuts))
    n = golden.select("question", "category", "spans").join(found, "question", "left")
    each = F.explode(F.array(*(F.struct(F.lit(k).cast("long").alias("k"), F.coalesce(f"h{k}", F.lit(0)).alias("hit")) for k in cuts)))
    rows = n.withColumn("x", each)
    return rows.select("question", "category", F.col("x.k").alias("k"), F.when(F.col("spans") > 0, F.col("x.hit") / F.col("spans")).alias("recall"))


def reciprocal_rank(hits: DataFrame, golden: DataFrame) -> DataFrame:
    first = hits.groupBy("question").agg(F.min("rank").alias("rank"))
    rr = F.when(F.col("spans") > 0, F.coalesce(1.0 / F.col("rank"), F.lit(0.0)))
    return golden.join(first, "question", "left").select("question", "category", rr.alias("rr"))


def scores(spans: DataFrame, golden: DataFrame, cuts: tuple[int, ...] = CUTS) -> DataFrame:
    """(question, category, spans, r<k>..., rr) of each golden question in one pass over its spans.

    ``spans``: (question, span, rank), a row for every span, once for each ranked row that covers
    it, with a null rank where none does.
    """
    best = spans.groupBy("question", "span").agg(F.min("rank").alias("rank"))
    found = best.groupBy("question").agg(F.count("*").alias("spans"), F.min("rank").alias("first"), *((F.count_if(F.col("rank") <= k) / F.count("*")).alias(f"r{k}") for k in cuts))
    rr = F.when(F.col("spans").isNotNull(), F.coalesce(1.0 / F.col("first"), F.lit(0.0)))
    return golden.join(found, "question", "left").select("question", "category", F.coalesce("spans", F.lit(0)).alias("spans"), *(f"r{k}" for k in cuts), rr.alias("rr"))


def mean_skipping_nan(column: str):
    return F.avg(F.when(~F.isnan(column), F.col(column)))


def with_total(rows: DataFrame, by: str, *aggregates) -> DataFrame:
    """Aggregates overall (category 'overall') and for each value of ``by``, in one pass."""
    r = rows.rollup(by).agg(F.grouping(by).alias("_all"), *aggregates)
    return r.withColumn(by, F.when(F.col("_all") == 1, "overall").otherwise(F.col(by))).drop("_all")


def first_of(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
