"""Writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F, types as T

from lendlens.operators.ranks import best_row
from lendlens.operators.schema import enforce_schema, validate_schema
from lendlens.shared import forget, settle


def write_chunks(df: DataFrame, path: str, rows: int = 250_000, schema: T.StructType | None = None) -> None:
    """Parquet files of at most ``rows`` rows; with ``schema``, rows are cast and checked first."""
    if schema is not None:
        df = enforce_schema(df, schema)
        validate_schema(df, schema)
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).parquet(path)


def write_partitioned(
    df: DataFrame, path: str, columns: Sequence[str] = ("activity_year", "loan_purpose_grouped"), files: int = 0
) -> None:
    """Parquet in one folder per value combination.

    ``files`` > 0 first spreads rows evenly, which bounds the number of files per folder without
    sending a hot year to one task.
    """
    (df.repartition(files) if files else df).write.mode("overwrite").partitionBy(*columns).parquet(path)


def write_range_chunks(df: DataFrame, path: str, number: str = "rn", chunks: int = 200) -> None:
    """Export in order of a row number, one contiguous range per file."""
    df.repartitionByRange(chunks, number).sortWithinPartitions(number).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, name: str, mode: str = "overwrite") -> None:
    """Create-or-replace or append."""
    df.write.mode(mode).format("parquet").saveAsTable(name)


def materialize(df: DataFrame, name: str, kind: str = "table") -> DataFrame:
    """Store a model's result as a table, or register it as a view."""
    if kind == "view":
        df.createOrReplaceTempView(name)
    else:
        write_table(df, name)
    return df.sparkSession.table(name)


def append_new(
    df: DataFrame, path: str, key: str, order: Sequence[Column] = (), partition: str | None = None, most_partitions: int = 1000
) -> None:
    """Append rows whose key is not stored yet; running it twice adds nothing.

    Of rows with one key the first by ``order`` is taken, then the fullest, then the smallest. With
    ``partition``, a column that depends on the key, the target is written by its values and only the
    stored ids of the values in ``df`` are read, as long as these are at most ``most_partitions``. One
    writer at a time: nothing guards against two.

    ``df`` is worked out once: its rows are reduced to one per key as they are shuffled by it, and these are
    settled until they are appended.
    """
    kept = settle(best_row(df, [key], order).select(*df.columns))
    fresh = kept
    try:
        stored = df.sparkSession.read.schema(df.schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    else:
        if partition is not None:
            found = [r[0] for r in kept.select(partition).distinct().limit(most_partitions + 1).collect()]
            if len(found) <= most_partitions:
                here = F.col(partition).isin([v for v in found if v is not None])
                stored = stored.filter(here | F.col(partition).isNull() if None in found else here)
        fresh = fresh.join(stored.select(key), key, "left_anti").select(*df.columns)
    writer = fresh.write.mode("append")
    (writer if partition is None else writer.partitionBy(partition)).parquet(path)
    forget(kept)


def append_log(df: DataFrame, path: str, schema: str) -> None:
    """Append metric, importance or experiment rows with a fixed schema."""
    typed = df.sparkSession.createDataFrame([], schema).schema
    enforce_schema(df, typed).write.mode("append").parquet(path)
