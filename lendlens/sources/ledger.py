"""Landing rows by id exactly once, batch by batch.

A target folder holds ``data/batch=<name>`` (the rows), ``ids/batch=<name>/prefix=<n>`` (their keys by a
prefix of the key's hash) and ``manifest``, one row per batch that counts. A batch is staged first and
counts from the moment its manifest row is there, which is one file and so appears whole or not at
all. What a writer left behind that died before that is never read and is replaced when the batch is
replayed; a batch that counts is not written again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lendlens.operators.ranks import best_row
from lendlens.shared import delete_path

#: Prefixes of the key's hash.
PREFIXES = 256
_MANIFEST = "batch string, landed_rows bigint, prefixes array<int>, ids_in string, replaces array<string>"


def manifest(spark: SparkSession, target: str) -> DataFrame:
    """One row per batch that counts, and per merge of id lists; empty before the first."""
    try:
        return spark.read.schema(_MANIFEST).parquet(f"{target}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _MANIFEST)


def landed(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    """All rows of the batches that count."""
    names = [r["batch"] for r in manifest(spark, target).filter("landed_rows IS NOT NULL").select("batch").collect()]
    paths = [f"{target}/data/batch={name}" for name in sorted(names)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def _prefix(key: str, prefixes: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(prefixes)).cast("int")


def _id_paths(entries: Sequence, target: str, prefixes: set[int] | None = None) -> list[str]:
    """Folders with the keys of these prefixes; a merged list stands for the lists it replaces."""
    gone = {b for e in entries for b in e["replaces"] or []}
    live = [e for e in entries if e["batch"] not in gone]
    return [f"{target}/{e['ids_in']}/prefix={p}" for e in live for p in e["prefixes"] if prefixes is None or p in prefixes]


def _commit(spark: SparkSession, target: str, row: tuple) -> None:
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("append").parquet(f"{target}/manifest")


def land_batch(
    df: DataFrame, target: str, key: str, batch: str, order: Sequence[Column] = (), prefixes: int = PREFIXES
) -> bool:
    """Land the rows of ``df`` whose key has not landed yet; false if ``batch`` had been landed before.

    Of rows with one key the first by ``order`` is taken, then the fullest, then the smallest; null is a key like
    any other. Of the stored keys only those under the prefixes that occur in ``df`` are read. ``batch`` names a
    folder, so it consists of letters, digits, ``-`` and ``_``; ``prefixes`` must be the same for all batches
    of a target. One writer at a time, as a stream is.
    """
    spark = df.sparkSession
    entries = manifest(spark, target).collect()
    if any(e["batch"] == batch for e in entries):
        return False
    data, ids = f"{target}/data/batch={batch}", f"{target}/ids/batch={batch}"
    for leftover in (data, ids):
        delete_path(spark, leftover)
    touched = {r[0] for r in df.select(_prefix(key, prefixes)).distinct().collect()}  # at most ``prefixes``
    fresh = best_row(df, [key], order).select(*df.columns)
    if stored := _id_paths(entries, target, touched):
        known = spark.read.schema(T.StructType([T.StructField("key", df.schema[key].dataType)])).parquet(*stored)
        # as a struct, null equals null
        fresh = fresh.withColumn("__k", F.struct(F.col(key).alias("key")))
        fresh = fresh.join(known.select(F.struct("key").alias("__k")), "__k", "left_anti").select(*df.columns)
    fresh.write.parquet(data)
    written = spark.read.schema(df.schema).parquet(data).select(F.col(key).alias("key"), _prefix(key, prefixes).alias("prefix"))
    counts = {r["prefix"]: r["n"] for r in written.groupBy("prefix").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts:
        written.repartition(min(len(counts), prefixes), "prefix").write.partitionBy("prefix").parquet(ids)
    _commit(spark, target, (batch, sum(counts.values()), sorted(counts), f"ids/batch={batch}", None))
    return True


def merge_ids(spark: SparkSession, target: str, name: str, key_type: str, prefixes: int = PREFIXES) -> None:
    """Put the id lists of all batches into one, so that a prefix is one folder again; it counts like a batch does."""
    entries = manifest(spark, target).collect()
    paths = _id_paths(entries, target)
    if not paths:
        return
    into = f"{target}/ids/merged={name}"
    delete_path(spark, into)
    rows = spark.read.schema(f"key {key_type}").parquet(*paths).select("key", _prefix("key", prefixes).alias("prefix"))
    rows.repartition(prefixes, "prefix").write.partitionBy("prefix").parquet(into)
    merged = sorted({p for e in entries for p in e["prefixes"]})
    _commit(spark, target, (f"merged-{name}", None, merged, f"ids/merged={name}", sorted({e["batch"] for e in entries})))
