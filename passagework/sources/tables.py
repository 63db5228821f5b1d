"""Readers: tables, whole text files, JSON run files; and tables derived from the given ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schemas at the boundary are written out, never inferred.
GOLDEN = (
    "id string, category string, question string, idealAnswer string, "
    "goldSpans array<struct<sourceSlug:string,charStart:int,charEnd:int>>, goldChunkIds array<int>, notes string"
)
RUN = "results array<struct<id:string,category:string,retrievedChunkIds:array<int>,similarities:array<double>,mrr:double>>, config map<string,string>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_texts(spark: SparkSession, path: str) -> DataFrame:
    """(id, text): each file as one string, named by its file name."""
    files = spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
    return files.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1).alias("id"), "text")


def golden_set(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=GOLDEN, multiLine=True)


def stored_run(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored result."""
    return spark.read.json(path, schema=RUN, multiLine=True).select(F.explode("results").alias("r")).select("r.*")


def source_url(id_):
    return F.format_string("https://example.org/texts/%d/%d.txt", id_, id_)


def known_or_fail(rows: DataFrame, manifest: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with the manifest's ``column``; a key that it lacks stops the query and lists those known."""
    known = manifest.agg(F.array_join(F.array_sort(F.collect_list(key)), ", ").alias("_known"))  # one row a source
    said = F.raise_error(F.concat(F.lit("unknown name "), F.col(key), F.lit("; known: "), "_known"))
    return rows.join(manifest, key, "left").join(F.broadcast(known)).withColumn(column, F.when(F.col(column).isNull(), said).otherwise(F.col(column))).drop("_known")


def source_dimension(documents: DataFrame) -> DataFrame:
    """One row per document source, with author and year made from its name."""
    number = F.regexp_extract("source", r"(\d+)$", 1).try_cast("int")
    return documents.where("source is not null").select("source").distinct().select(
        "source", F.concat(F.lit("Author "), F.upper("source")).alias("author"), F.concat(F.lit("Title of "), F.col("source")).alias("title"),
        F.when(number % 7 == 3, F.lit(None)).otherwise(number * 40 - 300).cast("long").alias("year"),
        F.when(number % 4 == 0, F.concat(F.lit("Translator "), number.cast("string"))).alias("translator"),
    )
