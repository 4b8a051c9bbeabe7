"""Helpers shared by the corpus operators: shared storage, words, bounded work."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The word of every contract here: a run of anything but ASCII white space.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of a row group of published tables: every writing and reading task holds one.
ROW_GROUP = 8 << 20
#: Rows that a task holds at once where it reads whole texts, as columns and as an Arrow batch: Spark's own numbers are for narrow rows.
FEW_ROWS = {"spark.sql.parquet.columnarReaderBatchSize": "256", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a folder of its own on a single machine (tests); on a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = getattr(spark.sparkContext, "_prosodia_dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='prosodia-')}"
        spark.sparkContext._prosodia_dir = found
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def publish(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends here and row
    identities such as monotonically_increasing_id() are fixed for every later reader."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._published = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete published tables that nothing reads any more. The driver's garbage goes with them, so that Spark's cleaner
    frees the shuffle files of finished jobs."""
    spark = tables[0].sparkSession
    for t in tables:
        remove(spark, t._published)
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextlib.contextmanager
def few_rows(spark: SparkSession):
    """Jobs that run within take texts by FEW_ROWS, or fewer if the session says so; then the session's numbers hold again."""
    before = {k: spark.conf.get(k) for k in FEW_ROWS}
    try:
        for k, v in FEW_ROWS.items():
            if not 0 < int(before[k]) < int(v):
                spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a column `name` that names each row: where it stands in its files or, if docs is more than columns and rows picked from files, a number
    that is written down with it."""
    plan = docs._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.child()
    if plan.getClass().getSimpleName().startswith("LogicalRelation"):
        return docs.select("*", F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place")).alias(name))
    return publish(docs.withColumn(name, F.struct(F.lit(0).cast("bigint").alias("file"), F.monotonically_increasing_id().alias("place"))), "numbered")


def unused(name: str, taken: list[str]) -> str:
    """name, with underscores added until it is none of the names taken (case aside)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def remove(spark: SparkSession, path: str) -> None:
    """Delete a shared folder through the file system that holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def words(text: Column) -> Column:
    """Words of a text in order; none for null and empty texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS, -1), lambda w: w != "")


def held_out(doc_id: Column, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder by 5; null ids count as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == remainder, F.lit(False))


def release_memory() -> None:
    """Give back what a reused worker still holds from an earlier stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
