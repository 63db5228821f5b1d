"""Prices of tokens and sums of usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Dollars per million tokens (input, output, cache write, cache read).
PRICES = {"large": (15.0, 75.0, 18.75, 1.5), "medium": (3.0, 15.0, 3.75, 0.3), "small": (1.0, 5.0, 1.25, 0.1), "local": (0.0, 0.0, 0.0, 0.0)}


# Dollars per million tokens of embedding models; others cost nothing.
EMBEDDING_PRICES = {"small": 0.02, "large": 0.13}


def embedding_cost(tokens: Column, model: Column) -> Column:
    rates = F.create_map(*(F.lit(x) for kv in EMBEDDING_PRICES.items() for x in kv))
    return tokens * F.coalesce(F.try_element_at(rates, model), F.lit(0.0)) / 1e6


def price_table(spark) -> DataFrame:
    rows = [(m, *p) for m, p in PRICES.items()]
    return spark.createDataFrame(rows, "model string, in_rate double, out_rate double, write_rate double, read_rate double")


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """``usage`` with cost; a model without a price costs nothing."""
    part = lambda n, r: F.coalesce(F.col(n), F.lit(0)) * F.coalesce(F.col(r), F.lit(0.0)) / 1e6
    total: Column = part("tokens_in", "in_rate") + part("tokens_out", "out_rate") + part("cache_write", "write_rate") + part("cache_read", "read_rate")
    return usage.join(F.broadcast(prices), "model", "left").withColumn("cost", total).drop("in_rate", "out_rate", "write_rate", "read_rate")
