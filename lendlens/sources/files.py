"""Readers for landed files. Everything arrives as text unless the file carries types."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lendlens.functions.text import CSV_NULL_TOKENS, null_if_in
from lendlens.schemas import COUNTY_FIPS, PIPE_LAR_COLUMNS, STATE_FIPS, text_schema
from lendlens.shared import settle


def blank_tokens(df: DataFrame, tokens: Sequence[str] = tuple(CSV_NULL_TOKENS)) -> DataFrame:
    """Null every text value that is one of ``tokens``."""
    return df.select(
        *[
            null_if_in(F.col(f.name), tokens).alias(f.name) if isinstance(f.dataType, T.StringType) else f.name
            for f in df.schema
        ]
    )


def path_year(path, pattern: str = r"(20\d{2})"):
    """Year in the name of the file's folder, or else in the file's own name."""
    folder, name = F.regexp_extract(path, r"([^/]*)/[^/]*$", 1), F.regexp_extract(path, r"([^/]*)$", 1)
    year = lambda part: F.regexp_extract(part, pattern, 1).try_cast("int")
    return F.coalesce(year(folder), year(name))


def file_year(pattern: str = r"(20\d{2})"):
    return path_year(F.input_file_name(), pattern)


def read_lar_csv(spark: SparkSession, path, columns: Sequence[str] | None = None) -> DataFrame:
    """Register CSV with a header, all text, no-value tokens as null, file year added.

    Without ``columns`` only the header is read to learn the names; types are never inferred.
    """
    reader = spark.read.option("header", True).option("inferSchema", False)
    if columns is not None:
        reader = reader.schema(text_schema(columns)).option("enforceSchema", False)
    return blank_tokens(reader.csv(path)).withColumn("file_year", file_year())


def read_pipe_lar(
    spark: SparkSession,
    path,
    state: str | None = None,
    county: str | None = None,
    names: Sequence[str] | None = tuple(PIPE_LAR_COLUMNS),
    state_column: str = "property_state",
    county_column: str = "property_county",
) -> DataFrame:
    """Pipe-delimited register, headerless with supplied names or, for ``names=None``, with a header."""
    reader = spark.read.option("sep", "|").option("inferSchema", False)
    df = reader.option("header", True).csv(path) if names is None else reader.schema(text_schema(names)).csv(path)
    if state is not None:
        df = df.filter(F.col(state_column) == state)
    if county is not None:
        df = df.filter(F.col(county_column) == county)
    return df


def read_state_fips(spark: SparkSession, path) -> DataFrame:
    return spark.read.schema(STATE_FIPS).option("sep", "|").option("header", True).csv(path)


def read_county_fips(spark: SparkSession, path) -> DataFrame:
    counties = spark.read.schema(COUNTY_FIPS).option("sep", "|").option("header", True).csv(path)
    return counties.withColumn("census_county_cd", F.concat("state_fips_cd", "county_fips_cd"))


def read_market_tsv(spark: SparkSession, path) -> DataFrame:
    """Tab-separated market tracker with a header; names lower-cased, all text."""
    return normalize_columns(spark.read.option("sep", "\t").option("header", True).csv(path))


def load_seed(spark: SparkSession, path, renames: Mapping[str, str] | None = None) -> DataFrame:
    """Small reference CSV loaded as text."""
    seed = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return seed.withColumnsRenamed(dict(renames or {}))


def normalize_columns(df: DataFrame) -> DataFrame:
    """Trim and lower-case names; spaces and hyphens become underscores."""
    return df.toDF(*[c.strip().lower().replace(" ", "_").replace("-", "_") for c in df.columns])


def read_csv_skip(spark: SparkSession, path, skip: int) -> DataFrame:
    """CSV files whose first ``skip`` lines stand above the header, all text, with ``source_file``.

    Lines are skipped by position, in each file; headers that differ by more than case, blanks and quotes raise an error. Only the
    first split of a file has lines to skip, and a line's position there is its number within its task,
    so large files are still read by many tasks.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("__block"),
        F.monotonically_increasing_id().alias("__id"),
    )
    # a row per file and of known size, so the lines are not shuffled for it
    firsts = settle(
        lines.filter("__block = 0").groupBy(F.col("source_file").alias("__file")).agg(F.min("__id").alias("__first"))
    )
    placed = lines.join(firsts, F.col("source_file") == F.col("__file")).withColumn(
        "__at", F.when(F.col("__block") == 0, F.col("__id") - F.col("__first"))
    )
    plain = F.regexp_replace(F.lower("value"), r'[\s"]', "")
    headers = placed.filter(F.col("__at") == skip).agg(
        F.min_by("value", "source_file").alias("value"), (F.min(plain) == F.max(plain)).alias("alike")
    )
    header = headers.first()
    if header[0] is None:
        raise ValueError(f"no file has a header after {skip} lines")
    if not header["alike"]:
        raise ValueError("the files have different headers")
    names = [n.strip() for n in next(csv.reader([header[0]]))]
    ddl = ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    rows = placed.filter((F.col("__at").isNull() | (F.col("__at") > skip)) & (F.trim("value") != ""))
    return normalize_columns(rows.select(F.from_csv("value", ddl).alias("r"), "source_file").select("r.*", "source_file"))


def read_parquet_dir(spark: SparkSession, path) -> DataFrame:
    """All Parquet files of a folder, matched by column name."""
    return spark.read.option("mergeSchema", True).parquet(*([path] if isinstance(path, str) else path))


def file_key(path):
    """A file's path without scheme, host and escapes, the same however the path was given."""
    plain = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.regexp_replace(F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B"))), "/+", "/")


def load_valid_files(spark: SparkSession, paths: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of the sound files, and one audit row per file with its row count and id range.

    A file counts as loaded only as a whole: all its rows, by its footer, can be decoded. Any other is
    rejected, rows before the damage included. Files are told apart by full path; a sound file without
    rows is loaded. The rows carry ``source_file``; a file named ``…_lo_hi`` is reported with that
    expected range next to what was found. ``paths`` is a list of files, not of rows.
    """
    reader = spark.read.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    schema = next((x for x in (_footer(spark, p) for p in paths) if x is not None), None)
    if schema is None:
        raise ValueError("none of the files has a readable schema")
    place = file_key(F.col("_metadata.file_path"))
    rows = reader.schema(schema).parquet(*paths).select("*", place.alias("source_file"))
    # counting without a column reads footers only; the digest needs every value
    promised = rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("promised"))
    span = [F.min("rn").alias("min_rn"), F.max("rn").alias("max_rn")] if "rn" in schema.names else []
    read = rows.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows_read"), F.bit_xor(F.xxhash64(*schema.names)).alias("__digest"), *span
    )
    found = settle(promised.join(read, "source_file", "left"))
    listing = spark.createDataFrame([(p,) for p in paths], "path string").select("path", file_key(F.col("path")).alias("source_file"))
    silent = [r.path for r in listing.join(found, "source_file", "left_anti").select("path").collect()]
    empty = [p for p in silent if _footer(spark, p) is not None]  # sound files without rows
    sound = F.coalesce(F.col("rows_read") == F.col("promised"), F.lit(False))
    bounds = lambda i: F.regexp_extract("file", r"_(\d+)_(\d+)\.parquet$", i).try_cast("bigint")
    no_rows = F.col("path").isin(empty) if empty else F.lit(False)
    audit = (
        listing.withColumn("file", F.regexp_extract("source_file", r"([^/]+)$", 1))
        .withColumns({"expected_from": bounds(1), "expected_to": bounds(2)})
        .join(found, "source_file", "left")
        .withColumn("loaded", sound | no_rows)
        .withColumn("rows_read", F.when(no_rows, F.lit(0)).otherwise(F.when(sound, F.col("rows_read"))))
    )
    for c in ("min_rn", "max_rn") if span else ():
        audit = audit.withColumn(c, F.when(F.col("loaded"), F.col(c)))
    accepted = found.filter(sound).select("source_file")
    return rows.join(accepted, "source_file", "left_semi").select(*schema.names, "source_file"), audit.drop("promised", "__digest")


def _footer(spark: SparkSession, path: str) -> T.StructType | None:
    """The file's schema, or None if its footer cannot be read."""
    try:
        return spark.read.parquet(path).schema
    except Exception:  # noqa: BLE001 - any unreadable footer
        return None
