"""Running streams to their end, and the live sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one where the session names none and all
    runs in one process. On a cluster that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="palaver-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def read_events(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of event files, so many to a batch."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def with_last(stream: DataFrame, whole: DataFrame, order: list[str], key: str = "session_id") -> DataFrame:
    """Marks each session's last row as ``last``, as the message that ends a session does. ``whole`` is the
    table that the stream reads; only a row a session is kept of it."""
    ends = whole.groupBy(key).agg(F.max(F.struct(*order)).alias("_end"))
    return stream.join(ends, key).withColumn("last", F.struct(*order) == F.col("_end")).drop("_end")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over all that is there, into Parquet in the shared folder, and reads that."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    base = f"{shared_dir(spark)}/palaver-streams/{uuid.uuid4().hex}/{name}"
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def append_batches(stream: DataFrame, write, checkpoint: str):
    """A live sink: ``write(batch, batch_id)`` per batch; returns the running query."""
    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(write).start()
