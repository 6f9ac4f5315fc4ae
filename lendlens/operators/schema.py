"""Schema enforcement, inference and audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

_WHOLE = (T.IntegerType, T.LongType, T.ShortType, T.ByteType)
_FLOAT = (T.DoubleType, T.FloatType)


def _cast(df: DataFrame, field: T.StructField) -> Column:
    """Column cast to the field's type: missing, unparseable and infinite values become null."""
    name, want = field.name, field.dataType
    if name not in df.columns:
        return F.lit(None).cast(want).alias(name)
    have, c = df.schema[name].dataType, F.col(name)
    if have == want:
        out = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c) if isinstance(want, _FLOAT) else c
    elif isinstance(want, _WHOLE) and not isinstance(have, (*_WHOLE, T.BooleanType)):
        x = c.try_cast("double")
        out = F.when(~F.isnan(x), F.round(x)).try_cast(want)
    elif isinstance(want, _FLOAT):
        x = c.try_cast("double")
        out = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x).try_cast(want)
    else:
        out = c.try_cast(want)
    return out.alias(name)


def enforce_schema(df: DataFrame, schema: T.StructType, keep_extra: bool = False) -> DataFrame:
    """Exactly the schema's columns and types. Extra ``*_category`` and ``*_bucketed`` become text."""
    extra = []
    if keep_extra:
        for c in df.columns:
            if c not in schema.names:
                text = c.endswith(("_category", "_bucketed"))
                extra.append(F.col(c).cast("string").alias(c) if text else F.col(c))
    return df.select(*[_cast(df, f) for f in schema], *extra)


def validate_schema(df: DataFrame, schema: T.StructType) -> None:
    """Raise on the first missing column or wrong type."""
    for field in schema:
        if field.name not in df.columns:
            raise ValueError(f"missing column {field.name}")
        have = df.schema[field.name].dataType
        if have != field.dataType:
            raise TypeError(f"{field.name} is {have.simpleString()}, expected {field.dataType.simpleString()}")


def coerce_schema(df: DataFrame, reference: T.StructType) -> DataFrame:
    """Cast to the first-seen schema, keeping further columns."""
    return enforce_schema(df, reference, keep_extra=True)


def schema_issues(name: str, have: T.StructType, want: T.StructType) -> list[tuple]:
    """(file, column, issue, actual, expected) for each difference."""
    kinds = lambda s: {f.name: f.dataType.simpleString() for f in s}
    a, b = kinds(have), kinds(want)
    rows = [(name, c, "Unexpected", a[c], None) for c in a if c not in b]
    rows += [(name, c, "TypeMismatch", a[c], b[c]) for c in a if c in b and a[c] != b[c]]
    return rows + [(name, c, "Missing", None, b[c]) for c in b if c not in a]


def schema_audit(
    spark: SparkSession, paths: Sequence[str], reference: T.StructType | None = None, parallelism: int = 16
) -> DataFrame:
    """Differences of each Parquet file from the first one (or ``reference``); footers only are read.

    ``paths`` is a list of files or folders, not of rows; ``parallelism`` of them are looked at together.
    """
    footer = inheritable_thread_target(spark)(lambda path: spark.read.parquet(path).schema)
    with ThreadPool(max(1, min(parallelism, len(paths)))) as pool:
        schemas = pool.map(footer, paths)
    reference = reference or (schemas[0] if schemas else T.StructType())
    rows = [issue for path, have in zip(paths, schemas) for issue in schema_issues(path, have, reference)]
    return spark.createDataFrame(rows, "file string, column_name string, issue string, actual string, expected string")


def align(df: DataFrame, schema: T.StructType, name: str = "") -> tuple[DataFrame, DataFrame]:
    """The frame cast to ``schema`` and a log row for each cast or filled column."""
    log = [
        (f, c, {"Missing": "filled", "TypeMismatch": "cast", "Unexpected": "dropped"}[issue], have, want)
        for f, c, issue, have, want in schema_issues(name, df.schema, schema)
    ]
    diag = df.sparkSession.createDataFrame(
        log, "file string, column_name string, action string, actual string, expected string"
    )
    return enforce_schema(df, schema), diag


def unify_schemas(
    schemas: Sequence[T.StructType], overrides: Mapping[str, T.DataType] | None = None
) -> T.StructType:
    """One schema for all years: columns in first-seen order, types widened, ``overrides`` win."""
    chosen: dict[str, T.DataType] = {}
    for schema in schemas:
        for f in schema:
            chosen[f.name] = _wider(chosen.get(f.name, f.dataType), f.dataType)
    chosen.update({k: v for k, v in (overrides or {}).items() if k in chosen})
    return T.StructType([T.StructField(n, t) for n, t in chosen.items()])


def _wider(a: T.DataType, b: T.DataType) -> T.DataType:
    if a == b:
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(b, T.NullType):
        return a
    if isinstance(a, _WHOLE) and isinstance(b, _WHOLE):
        return T.LongType()
    if isinstance(a, (*_WHOLE, *_FLOAT)) and isinstance(b, (*_WHOLE, *_FLOAT)):
        return T.DoubleType()
    return T.StringType()


def create_table_ddl(name: str, schema: T.StructType) -> str:
    columns = ",\n  ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return f"create or replace table {name} (\n  {columns}\n)"


def rename_map(df: DataFrame, renames: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(renames))


def each_column(columns: Sequence[str], build) -> list[Column]:
    """The same projection for many columns, for use in one ``select``."""
    return [build(c) for c in columns]


def numeric_text_columns(
    df: DataFrame, threshold: float = 0.9, preserve: Sequence[str] = (), strict: bool = False
) -> list[str]:
    """Text columns whose non-null values are numbers often enough.

    The share is taken over the whole column in one map-side-combined aggregate, not over the first
    values of each file, so the answer does not depend on how rows are split into files. ``strict``
    demands a share above the threshold instead of at least the threshold.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name not in preserve]
    if not texts:
        return []
    parses = lambda c: F.when(F.col(c).isNotNull(), F.col(c).try_cast("double").isNotNull().cast("int"))
    shares = df.agg(*[F.avg(parses(c)).alias(c) for c in texts]).first()  # one row
    enough = (lambda p: p > threshold) if strict else (lambda p: p >= threshold)
    return [c for c in texts if shares[c] is not None and enough(shares[c])]


def infer_numeric(
    df: DataFrame, threshold: float = 0.9, preserve: Sequence[str] = (), strict: bool = False
) -> DataFrame:
    """Cast the columns picked by :func:`numeric_text_columns` to double, the rest stay text."""
    chosen = set(numeric_text_columns(df, threshold, preserve, strict))
    return df.select(*[F.col(c).try_cast("double").alias(c) if c in chosen else F.col(c) for c in df.columns])
