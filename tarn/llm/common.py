"""What the operators of this subpackage share: the shared scratch folder, row keys and checked broadcasts."""

from __future__ import annotations

import contextlib
import hashlib
import re
import tempfile
import threading
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
NO_ID = -(2**63)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary folder stands in for it only where all runs on one machine, as in tests."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tarn-"))
        folder = sc.getCheckpointDir()
    return folder.rstrip("/")


#: Bytes of a batch of rows that goes to a Python worker or comes back, roughly; a longer row is a batch of its own.
BATCH_BYTES = 2 << 20
#: Rows of a batch of the Parquet reader.
READ_ROWS = 512
_OPEN = threading.local()


def bound_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches of this session by bytes, and batches of the Parquet reader by fewer rows, unless the session has settings of its own: thousands of long texts are too much for a batch."""
    known = spark._jsparkSession.sessionState().conf()
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES), ("spark.sql.parquet.columnarReaderBatchSize", READ_ROWS)):
        if not known.contains(key):
            spark.conf.set(key, str(value))


def save(df: DataFrame) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: it cuts the lineage, and a lost executor costs no recomputation. Within spare_tables() the table lasts until that ends."""
    spark = df.sparkSession
    bound_batches(spark)
    path = f"{scratch(spark)}/tarn-{uuid.uuid4().hex}"
    if tables := getattr(_OPEN, "tables", None):
        tables[-1].append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def spare_tables():
    """Deletes at its end the tables that save() has written within. What is read after that must have been saved outside."""
    tables = _OPEN.__dict__.setdefault("tables", [])
    tables.append([])
    try:
        yield
    finally:
        for spark, path in tables.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def outlive(df: DataFrame) -> DataFrame:
    """save(), for a table that is read after the innermost spare_tables() has ended; it lasts as long as one around that."""
    tables = getattr(_OPEN, "tables", [])
    inner = tables.pop() if tables else None
    try:
        return save(df)
    finally:
        if inner is not None:
            tables.append(inner)


def broadcast_if(df: DataFrame, most_rows: int) -> DataFrame:
    """Hints a broadcast only if df, a saved table, has at most so many rows; else Spark shuffles both sides."""
    return F.broadcast(df) if df.count() <= most_rows else df


def release() -> None:
    """Gives back to the system what this Python worker has freed. Workers live on between stages, and what they hold counts against their executor."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def releasing(run):
    """run, a function over Arrow batches or columns, with release() once its task is through."""

    def then_release(batches):
        yield from run(batches)
        release()

    return then_release


def releasing_group(run):
    """run, a function over the Arrow tables of a group or of two cogrouped ones, or over a key and two, with release() after each group that isn't small."""

    def then_release(*args):
        out = run(*args)
        if sum(t.nbytes for t in args if hasattr(t, "nbytes")) > BATCH_BYTES:
            release()
        return out

    # Spark counts the arguments
    return [lambda a: then_release(a), lambda a, b: then_release(a, b), lambda a, b, c: then_release(a, b, c)][run.__code__.co_argcount - 1]


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def keyed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, _d, _r): only the columns needed, so that others can't clash. (_d, _r) names a row by id and text; rows equal in both get equal results, so repeated rows and null ids are safe to join on."""
    return docs.select(
        F.col(key).cast("long").alias(key),
        F.col(text).cast("string").alias(text),
        F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("_d"),
        F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_r"),
    )


def with_keys(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with all its columns, and the names of rows that keyed() gives as __tarn_d and __tarn_r."""
    return docs.withColumns({"__tarn_d": F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)), "__tarn_r": F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))})


def without(docs: DataFrame, rows: DataFrame, most_rows: int) -> DataFrame:
    """The rows of docs (doc_id, text and any others) that are not among rows (_d, _r), a saved table."""
    named = rows.select(F.col("_d").alias("__tarn_d"), F.col("_r").alias("__tarn_r"))
    return with_keys(docs).join(broadcast_if(named, most_rows), ["__tarn_d", "__tarn_r"], "left_anti").drop("__tarn_d", "__tarn_r")


def sha256_hex(s: str) -> str:
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
