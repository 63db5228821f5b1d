"""Tables that outlive a query: where they lie, and upserts that replace whole buckets in one step."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from . import writers


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
    """``df`` as a Parquet table in the shared folder, read back: later steps start from there."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 256) -> Iterator[None]:
    """Steps run in here hand at most ``rows`` rows to Python at a time, as rows of long texts or packed blocks need."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def built_once(source: DataFrame, kind: str, build: Callable[[str], None]) -> str:
    """The path of what ``build(path)`` made of a table of files; made once a session and set of files.

    A mark is written when it is whole; where that is gone, as after a clearing of the folder, it is made anew.
    Its name begins with an underscore, so that readers of a table in this very folder pass it over.
    """
    spark = source.sparkSession
    name = hashlib.md5("\n".join([kind, *sorted(source.inputFiles())]).encode()).hexdigest()
    path = spark.conf.get(f"passagework.built.{name}", None)
    if path is None or not _is_there(spark, f"{path}/_made"):
        path = f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"
        build(path)
        spark.range(1).coalesce(1).write.json(f"{path}/_made")
        spark.conf.set(f"passagework.built.{name}", path)
    return path


def _is_there(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.schema("id long").json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def there(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The Parquet table at ``path``, empty where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


# -- upserts ----------------------------------------------------------------------------------------


def _live(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """(number, bucket -> folder) of the newest complete list of a table's buckets."""
    try:
        rows = spark.read.schema("number int, bucket int, folder string").json(f"{path}/lists/*").collect()  # a row a bucket and kept list
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    number = max((r["number"] for r in rows), default=0)
    return number, {r["bucket"]: r["folder"] for r in rows if r["number"] == number}


def current(spark: SparkSession, path: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
    """The rows of an upserted table, of some of its buckets if given."""
    _, live = _live(spark, path)
    folders = sorted({f"{path}/{folder}/bucket={b}" for b, folder in live.items() if buckets is None or b in buckets})
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def upsert_into(new: DataFrame, path: str, key: list[str], buckets: int = 64) -> list[int]:
    """Rows of ``new`` take the place of those with their keys, others join them; the buckets rewritten.

    Keys are dealt to ``buckets`` by hash. Only buckets that hold a new or changed row are written
    anew, beside the old ones; then one small list of live folders is added, so a reader sees the
    table before or after and a failed write leaves it as it was. A rerun changes nothing. Within ``new``
    keys are unique.
    """
    spark = new.sparkSession
    number, live = _live(spark, path)
    schema = ", ".join(f"`{c}` {t}" for c, t in new.dtypes)
    dealt = new.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    asked = [r["bucket"] for r in dealt.select("bucket").distinct().collect()]  # at most ``buckets``
    old = current(spark, path, schema, asked)
    fresh = dealt.select("bucket", F.struct(*new.columns).alias("row")).join(old.select(F.struct(*new.columns).alias("was")), F.col("row").eqNullSafe(F.col("was")), "left_anti")
    touched = sorted(r["bucket"] for r in fresh.select("bucket").distinct().collect())
    if not touched:
        return []
    own = dealt.where(F.col("bucket").isin(touched)).drop("bucket")
    rows = writers.upsert(current(spark, path, schema, touched), own, key)
    folder = f"rows-{uuid.uuid4().hex}"
    rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions(*key).write.partitionBy("bucket").parquet(f"{path}/{folder}")
    now = [(number + 1, b, f) for b, f in sorted((live | dict.fromkeys(touched, folder)).items())]
    spark.createDataFrame(now, "number int, bucket int, folder string").coalesce(1).write.json(f"{path}/lists/{number + 1}")
    return touched


# -- chunks -----------------------------------------------------------------------------------------


#: Names of sources up to this number become a filter on folders, more are joined.
FEW_SOURCES = 1000


def stored_chunks(spark: SparkSession, path: str, version: str, sources: DataFrame | None = None) -> DataFrame:
    """Chunks of one version, of the named sources if given: both are folders, so that only their files are read."""
    rows = spark.read.parquet(path).where(F.col("chunking_version") == version)
    if sources is None:
        return rows
    names = sources.select("source_id").distinct()
    few = [r["source_id"] for r in names.limit(FEW_SOURCES + 1).collect()]
    return rows.where(F.col("source_id").isin(few)) if len(few) <= FEW_SOURCES else rows.join(names, "source_id", "left_semi")


# -- notes ------------------------------------------------------------------------------------------


def noted(chunks: DataFrame, path: str, make: Callable[[str, str], str], unit: int = 50, tries: int = 3) -> DataFrame:
    """The notes of all ``chunks`` (key, profile, text), those written before as they are, the others made now.

    Work is dealt by profile and sorted within a task, so a task asks one profile after another. Each
    task writes its finished rows in units of ``unit`` as files of their own: a run that stops half way
    has kept them, and the next takes up what isn't there. A call that fails is tried again; after
    ``tries`` the note is empty. Each row tells its tries and the last message.
    """
    spark = chunks.sparkSession
    schema = "key string, profile string, note string, tries int, message string"
    done = there(spark, path, schema)
    todo = chunks.join(done.select("key"), "key", "left_anti").select("key", "profile", "text")

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for key, profile, text in zip(*(b.column(c).to_pylist() for c in ("key", "profile", "text")), strict=True):
                note, message, n = None, None, 0
                while note is None and n < tries:
                    n += 1
                    try:
                        note = make(profile, text)
                    except Exception as e:  # noqa: BLE001  a failed call is a value, its row stays
                        message = str(e)
                out.append((key, profile, note or "", n, message))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string()), strict=True)], names=["key", "profile", "note", "tries", "message"])

    # A commit each unit of every task: one unit of all tasks a round, until nothing is left.
    rank = F.row_number().over(Window.partitionBy(F.spark_partition_id()).orderBy("profile", "key"))
    placed = written(todo.repartition("profile", F.pmod(F.xxhash64("key"), F.lit(8))).withColumn("round", F.floor((rank - 1) / unit)))
    last = placed.agg(F.max("round")).first()[0]
    for k in range(-1 if last is None else last + 1):
        one = placed.where(F.col("round") == k).repartition("profile", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("profile", "key")
        one.drop("round").mapInArrow(asked, schema).write.mode("append").parquet(path)
    return there(spark, path, schema).join(chunks.select("key"), "key", "left_semi")


# -- runs -------------------------------------------------------------------------------------------


def write_run(results: DataFrame, path: str, costs: list[str]) -> dict[str, float]:
    """Write a run's rows, one struct a question, as JSON; their number and cost totals from the same pass.

    Missing costs count as nothing. The totals are observed while rows are written, not read again.
    """
    seen = Observation("run")
    told = results.observe(seen, F.count("*").alias("questions"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in costs))
    told.write.mode("overwrite").json(path)
    return seen.get
