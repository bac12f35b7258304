"""Replays of tables as streams: rows land in a folder, delivery by delivery, and a job picks up what is new."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.types import StructType

from listaro.staging import shared_dir
from listaro.streaming.jobs import STATE_STORE


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of the same application with the state store that the jobs need; days begin at midnight UTC."""
    own = spark.newSession()
    width = "spark.sql.shuffle.partitions"
    for key, value in (STATE_STORE | {"spark.sql.session.timeZone": "UTC", width: spark.conf.get(width)}).items():
        own.conf.set(key, value)
    return own


def new_folder(spark: SparkSession, label: str) -> str:
    """A folder below the shared one, deleted when the application ends."""
    path = f"{shared_dir(spark)}/listaro/{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def replay(spark: SparkSession, deliveries: Iterable[DataFrame], root: str, write: Callable[[DataFrame], DataStreamWriter]) -> list[StreamingQuery]:
    """Land each delivery below ``root`` and run the job once after it, from the same checkpoint, as a nightly run does.

    ``write`` makes the job's writer from the stream of all deliveries. Each run
    takes what is new as one micro-batch, and then ends.
    """
    runs = []
    for number, rows in enumerate(deliveries):
        rows.write.parquet(f"{root}/landed/delivery={number:06}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/landed/delivery=*")
        run = write(stream).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        run.awaitTermination()
        runs.append(run)
    return runs


def replayed(spark: SparkSession, deliveries: Iterable[DataFrame], job: Callable[[DataFrame], DataFrame], label: str) -> tuple[str, StructType, list[StreamingQuery]]:
    """(path, schema, runs): the table of all that a job in append mode has emitted after all deliveries, and its runs."""
    root = new_folder(spark, label)
    schema = []

    def write(stream: DataFrame) -> DataStreamWriter:
        out = job(stream)
        schema[:] = [out.schema]
        return out.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out")

    runs = replay(spark, deliveries, root, write)
    return f"{root}/out", schema[0], runs
