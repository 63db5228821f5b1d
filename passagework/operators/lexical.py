"""Postings and BM25 scores for many queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import words

K1, B = 1.2, 0.75
#: A side up to this many rows is broadcast, beyond it both are shuffled.
SMALL_ROWS = 200_000


def small(side: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``side`` marked for broadcast if it is counted and small enough."""
    return F.broadcast(side) if side.limit(rows + 1).count() <= rows else side


def tokens_of(texts: DataFrame, key: str) -> DataFrame:
    """(key, dl, term) of every token. The length is taken before the tokens are exploded, else
    each token's row would split its text anew; an outer explode because a plain one has the
    optimizer test the tokens of each text first, which splits it again. Callers join on terms,
    so the row without a term that an empty text gives is dropped there.
    """
    cut = texts.select(key, words(F.col("text")).alias("w"))
    return cut.select(key, F.size("w").cast("double").alias("dl"), "w").select(key, "dl", F.explode_outer("w").alias("term"))


def postings(texts: DataFrame, key: str) -> DataFrame:
    """(key, term, tf, dl): term and document frequencies are sums over it."""
    rows = tokens_of(texts, key).select(key, F.col("dl").cast("long").alias("dl"), "term").where("term is not null")
    return rows.groupBy(key, "term", "dl").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, key: str, n: int | None = None) -> DataFrame:
    """(key, term, qf) of the query texts, of their first ``n`` tokens if given."""
    w = words(F.col("text"))
    return queries.select(key, F.explode(F.slice(w, 1, n) if n else w).alias("term")).groupBy(key, "term").agg(F.count("*").alias("qf"))


def bm25(texts: DataFrame, key: str, terms: DataFrame, query: str) -> DataFrame:
    """(query, key, score). Only postings of query terms are counted and shuffled."""
    terms = small(terms)
    w = words(F.col("text"))
    length = texts.select(F.size(w).cast("double").alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    asked = F.broadcast(terms.select("term").distinct()) if terms.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else terms.select("term").distinct()
    tokens = tokens_of(texts, key).join(asked, "term", "left_semi")
    tf = tokens.groupBy("term", key, "dl").agg(F.count("*").cast("double").alias("tf"))
    # Reading tf here keeps both branches alike, so that its shuffle is made once and used twice.
    df = tf.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    stats = df.join(F.broadcast(length)).select("term", "avgdl", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    weight = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = tf.join(small(stats), "term").select("term", key, weight.alias("w"))
    return scored.join(terms, "term").groupBy(query, key).agg(F.sum(F.col("w") * F.col("qf")).alias("score"))
