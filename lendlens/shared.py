"""Tables written to the folder every executor can reach.

Two needs are served by one device. A multi-pass operator must see the same rows in the same
partitions in each pass even when executors are lost, and a small aggregate must have a known size
before it is joined to a big table so that Spark itself can decide whether broadcasting it is safe.
Both are met by writing the frame as Parquet and reading it back.
"""

from __future__ import annotations

import uuid
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession

_DIR_KEY = "spark.checkpoint.dir"
_paths: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; where that is unset, one beside the shared warehouse.

    A warehouse in a ``file:`` folder is a folder of each machine, so it is refused unless the session is local.
    """
    named = spark.conf.get(_DIR_KEY, None)
    if named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not _is_local(spark.conf.get("spark.master", "local")) and (warehouse.startswith("file:") or ":" not in warehouse):
        raise ValueError(f"set {_DIR_KEY} to a folder that all machines share; {warehouse} is not one")
    return warehouse + "-settled"


def _is_local(master: str) -> bool:
    """Whether driver and executors are one process."""
    return master == "local" or master.startswith("local[")


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/lendlens/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession) -> str:
    """A fresh path in this application's part of the shared folder."""
    return f"{_own_folder(spark)}/{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> bool:
    """Delete a file or folder in whatever store the path names; false if there was none."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def clear_settled(spark: SparkSession) -> bool:
    """Delete everything this application has settled; frames read from it cannot be used any more."""
    return delete_path(spark, _own_folder(spark))


def forget(*frames: DataFrame) -> None:
    """Delete the tables of frames that :func:`settle` returned, once all that reads them is written."""
    for df in frames:
        if path := _paths.pop(df, None):
            delete_path(df.sparkSession, path)


def settle(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return it as a plain Parquet scan.

    Unlike a cached frame the result survives the loss of any executor, and unlike an RDD
    checkpoint it is compressed, column-pruned on re-read and has file-size statistics.
    """
    spark = df.sparkSession
    path = new_path(spark)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out
