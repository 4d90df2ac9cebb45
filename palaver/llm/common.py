"""Helpers that the operators share: tables, the shared scratch folder, columns by place, text bytes."""

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

#: One word: a run of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Frees a query's shuffle files at its end; a stage that misses them runs again.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set if all runs in one process; on a cluster
    this is an error, for executors would each write to a disk of their own.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="palaver-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder. What is left there goes when the application ends."""
    top = f"{shared_dir(spark)}/palaver/{uuid.uuid4().hex}"
    place, at = _path(spark, top)
    place.mkdirs(at)
    place.deleteOnExit(at)
    return f"{top}/{name}"


@contextlib.contextmanager
def freeing_shuffles(spark: SparkSession):
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE_SHUFFLES, before)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors. Shuffle files
    of the write are freed with it; the folder stays until :func:`drop` or the application's end."""
    spark = df.sparkSession
    path = scratch(spark, name)
    with freeing_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = [path.rpartition("/")[0]]
    return out


def holding(out: DataFrame, *made: DataFrame) -> DataFrame:
    """``out``, which reads the frames ``made``: dropping it drops them."""
    out._scratch = [p for df in made for p in df.__dict__.get("_scratch", [])]
    return out


def drop(*made: DataFrame) -> None:
    """Deletes the folders of materialized frames that nothing reads any more."""
    for df in made:
        for path in df.__dict__.pop("_scratch", []):
            place, at = _path(df.sparkSession, path)
            place.delete(at, True)


#: Rows and bytes in an Arrow batch, and rows in a batch of Parquet, at most: what a Python worker and its executor hold of long texts.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 250, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}


def in_batches(df: DataFrame) -> DataFrame:
    """The frame, in a session whose Arrow batches are bounded by ``BATCHES``; smaller settings stay."""
    for key, most in BATCHES.items():
        told = re.fullmatch(r"(\d+)([bkmg]?)b?", df.sparkSession.conf.get(key).lower())
        now = int(told[1]) * {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[told[2]] if told else 0
        if not 0 < now <= most:
            df.sparkSession.conf.set(key, str(most))
    return df


#: Large tables that a Python worker keeps from task to task, by who uses them.
KEPT: dict[str, dict] = {}


def _release(keeps: str | None = None) -> None:
    """Gives memory that is free back to the system; with ``keeps``, drops all other large tables before."""
    others = [held for name, held in KEPT.items() if keeps not in (None, name) and held]
    for held in others:
        held.clear()
    if others:
        gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL(None).malloc_trim(0)


def lean(run, keeps: str = ""):
    """``run`` over batches, in a worker that holds no large tables but those it ``keeps`` and gives back what it freed.

    Workers are used again by later stages, and idle ones hold what they had.
    """

    def leanly(batches):
        _release(keeps)  # by its name: what stands here goes to the worker as a copy
        try:
            yield from run(batches)
        finally:
            _release()

    return leanly


def by_place(df: DataFrame) -> DataFrame:
    """The same columns as c0, c1 and so on: names may clash with others, places can't."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def place_of(df: DataFrame, name: str) -> str:
    """A column's name in :func:`by_place`."""
    return f"c{df.columns.index(name)}"


def utf8(col: str) -> Column:
    """The text as binary, null as empty."""
    return F.coalesce(F.col(col).cast("binary"), F.lit(b""))
