"""Tool-call logs: counts, first uses, cuts and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tool_counts(log: DataFrame) -> DataFrame:
    """(run, tools): calls by tool name, as a map."""
    n = log.groupBy("run", "tool").agg(F.count("*").alias("n"))
    return n.groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("tools"))


def until_terminal(log: DataFrame, terminal: str, turn: str = "seq") -> DataFrame:
    """Each run's calls up to and including the whole turn of its first terminal call."""
    w = Window.partitionBy("run")
    end = F.min(F.when(F.col("tool") == terminal, F.col(turn))).over(w)
    return log.withColumn("_end", end).where(F.col("_end").isNull() | (F.col(turn) <= F.col("_end"))).drop("_end")


def within_budget(log: DataFrame, cost: str, cap: float, most: int) -> DataFrame:
    """Calls that begin while the run's cost so far is within the cap, ``most`` at most."""
    w = Window.partitionBy("run").orderBy("seq")
    before = F.coalesce(F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return log.withColumns({"spent": before, "n": F.row_number().over(w)}).where((F.col("spent") <= cap) & (F.col("n") <= most))


def paced(log: DataFrame, arrival: str, gap: float) -> DataFrame:
    """``start``: the earliest time that keeps arrivals and a gap between starts of one run.

    start_i = max(arrival_i, start_{i-1} + gap) in closed form by a running maximum.
    """
    w = Window.partitionBy("run").orderBy("seq")
    i = F.row_number().over(w) - 1
    rows = log.withColumn("_i", i)
    lead = F.max(F.col(arrival) - F.col("_i") * gap).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("start", F.col("_i") * gap + lead).drop("_i")
