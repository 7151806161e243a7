"""Where intermediate tables go: the folder in ``spark.checkpoint.dir``, shared by all executors.

Only where that setting is absent and the master is local is a temporary folder made; a cluster without it is
refused, since no other folder is known to be shared.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; also makes it the checkpoint folder of the session if none was set."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="cinelake-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found if "://" in found or found.startswith("file:") else sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a table and read back: its lineage ends, and losing executors loses nothing.

    Unlike a checkpointed plan the table has its true size, by which the joins that follow are chosen.
    """
    spark = df.sparkSession
    path = new_path(spark, "table")
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def release(table: DataFrame) -> None:
    """Deletes the table behind a frame that ``checkpoint`` gave, once nothing will read it any more."""
    if path := getattr(table, "_written_to", None):
        _drop(table.sparkSession, path)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver's Python ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file of the shared folder, through the file system that Spark itself uses for it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    stream.write(bytearray(data))
    stream.close()


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may have ended before
        pass
