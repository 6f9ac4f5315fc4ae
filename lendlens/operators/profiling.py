"""Column profiles, outlier summaries and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from lendlens.functions.numbers import ratio
from lendlens.operators.quantiles import column_name, long_values, quantiles_of_counts
from lendlens.shared import settle


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Row count and ``<column>_null_count`` for every column, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"{c}_null_count") for c in columns or df.columns],
    )


def _spread(one: DataFrame, columns: Sequence[str], fields: dict[str, str]) -> DataFrame:
    """One wide row of ``<column>__<field>`` to one row per column."""
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("feature"), *[F.col(f"{c}__{k}").cast(t).alias(k) for k, t in fields.items()])
            for c in columns
        ]
    )
    return one.select(F.explode(rows).alias("r")).select("r.*")


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Columns with missing values and how many, most first."""
    columns = list(columns or df.columns)
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}__n_missing") for c in columns])
    return _spread(one, columns, {"n_missing": "bigint"}).filter("n_missing > 0").orderBy(F.desc("n_missing"), "feature")


def profile_numeric(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Moments, range, distinct values and advice per numeric column."""
    columns = list(columns or numeric_columns(df))
    stats = {
        "n": (F.count, "bigint"),
        "skewness": (F.skewness, "double"),
        "std_dev": (F.stddev, "double"),
        "mean": (F.avg, "double"),
        "min": (F.min, "double"),
        "max": (F.max, "double"),
    }
    moments = df.agg(*[f(F.col(c).cast("double")).alias(f"{c}__{k}") for c in columns for k, (f, _) in stats.items()])
    base = _spread(moments, columns, {k: t for k, (_, t) in stats.items()})
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])
    distinct = (
        df.select(F.explode(pairs).alias("p"))
        .select("p.*")
        .filter("v is not null")
        .distinct()
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("n_distinct"))
    )
    c = F.col
    advice = (
        F.when(c("skewness") > 1, "log-transform or bin to reduce right skew")
        .when(c("skewness") < -1, "transform to reduce left skew")
        .otherwise("scale or normalize as needed")
    )
    return base.join(distinct, "feature").select(
        "*",
        advice.alias("recommendation"),
        (c("n_distinct") < 10).alias("few_values"),
        (c("std_dev") == 0).alias("no_variance"),
        (c("max") > c("mean") * 10).alias("possible_outliers"),
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, value, n) over several columns, nulls included."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.column_name", "p.value").agg(F.count(F.lit(1)).alias("n"))


def profile_categorical(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Value counts with each value's share of its column's rows."""
    counts = settle(value_counts(df, list(columns or text_columns(df))))
    totals = counts.groupBy("column_name").agg(F.sum("n").alias("total"))
    return counts.join(totals, "column_name").select(
        "column_name", "value", "n", ratio(F.col("n"), F.col("total")).alias("share")
    )


def category_balance(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Largest category per column and how dominant it is."""
    shares = profile_categorical(df, columns)
    top = shares.groupBy("column_name").agg(
        F.min(F.struct((-F.col("n")).alias("k"), "value", "share")).alias("t")
    )
    pct = F.col("t.share") * 100
    verdict = (
        F.when(pct > 80, "highly imbalanced").when(pct > 50, "moderately imbalanced").otherwise("balanced")
    )
    return top.select("column_name", F.col("t.value").alias("top_category"), pct.alias("top_pct"), verdict.alias("verdict"))


def numeric_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, reach: float = 1.5, z: float = 3.0
) -> DataFrame:
    """Rows outside the quartile fences and beyond ``z`` standard deviations, per column."""
    columns = list(columns or numeric_columns(df))
    counted = settle(long_values(df, [], columns).groupBy("column_id", "value").agg(F.count(F.lit(1)).alias("n")))
    v, n, key = F.col("value"), F.col("n"), "column_id"
    means = counted.groupBy(key).agg((F.sum(v * n) / F.sum(n)).alias("__mean"))
    spread = (
        counted.join(means, key)
        .groupBy(key)
        .agg(F.max("__mean").alias("__mean"), F.sqrt(F.sum((v - F.col("__mean")) ** 2 * n) / F.sum(n)).alias("__sd"))
    )
    limits = settle(spread.join(quantiles_of_counts(counted, [key], [0.25, 0.75]), key))
    fence = (F.col("q1") - F.col("q0")) * reach
    outside = (v < F.col("q0") - fence) | (v > F.col("q1") + fence)
    far = F.abs(v - F.col("__mean")) > F.col("__sd") * z
    rows = df.agg(F.count(F.lit(1))).scalar()
    found = counted.join(limits, key).groupBy(key).agg(
        F.coalesce(F.sum(F.when(outside, n)), F.lit(0)).alias("iqr_outliers"),
        F.coalesce(F.sum(F.when(far, n)), F.lit(0)).alias("z_outliers"),
    ).withColumn("total_rows", rows)
    pct = lambda c: (ratio(F.col(c), F.col("total_rows")) * 100).alias(f"{c}_pct")
    return found.select(column_name(columns), "total_rows", "iqr_outliers", pct("iqr_outliers"), "z_outliers", pct("z_outliers"))


def rare_categories(df: DataFrame, columns: Sequence[str] | None = None, threshold: float = 0.01) -> DataFrame:
    """How many categories are rarer than ``threshold`` and how many rows they hold, per column."""
    rare = F.col("share") < threshold
    return profile_categorical(df, columns).groupBy("column_name").agg(
        F.sum("n").alias("total_rows"),
        F.count_if(rare).alias("rare_categories"),
        F.coalesce(F.sum(F.when(rare, F.col("n"))), F.lit(0)).alias("outlier_rows"),
    )


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins between the column's own minimum and maximum; empty bins are left out."""
    x = F.col(column).cast("double")
    ends = settle(df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"))).select(F.struct("lo", "hi")).scalar()
    width = (F.col("e.hi") - F.col("e.lo")) / bins
    step = F.floor((x - F.col("e.lo")) / F.nullif(width, F.lit(0.0)))
    number = F.least(F.coalesce(step, F.lit(0)), F.lit(bins - 1))
    binned = df.filter(x.isNotNull()).withColumn("e", ends).select(
        (number + 1).cast("int").alias("bin"), F.col("e.lo").alias("lo"), width.alias("w")
    )
    return binned.groupBy("bin", "lo", "w").agg(F.count(F.lit(1)).alias("n")).select(
        "bin", (F.col("lo") + (F.col("bin") - 1) * F.col("w")).alias("bin_start"), "n"
    )
