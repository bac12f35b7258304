"""Intermediate tables in the folder that all machines of a cluster share.

Iterative jobs cut their lineage here: a staged table is a Parquet folder below
``spark.checkpoint.dir``, so losing an executor never loses it, and reading it
back gives fresh statistics and shuffles that adaptive execution can split.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
#: Folders of applications whose settings name none, by application.
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is named and all runs on one machine (tests)."""
    found = spark.conf.get(KEY, None)
    if found:
        return found
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError(f"{KEY} must name a folder that all machines of the cluster share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="listaro-")
    return _OWN[app]


def read_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Read a Parquet table with plain reads: vectored ones hold a direct buffer per column chunk and thread."""
    reader = spark.read.option("parquet.hadoop.vectored.io.enabled", "false")
    return (reader.schema(schema) if schema is not None else reader).parquet(path)


def stage(df: DataFrame, label: str, rebalance: bool = True) -> DataFrame:
    """Write ``df`` below the shared folder and return a reader of it.

    With ``rebalance`` the rows are first dealt into files of the advisory
    partition size; for compact tables that costs little and saves many small
    files. The folder is deleted when the Spark application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/listaro/{label}-{uuid.uuid4().hex}"
    (df.hint("rebalance") if rebalance else df).write.parquet(path)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return read_table(spark, path, df.schema)


def drop_stage(df: DataFrame) -> None:
    """Delete a staged table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_width(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
