"""Repeatable samples, splits and chunk numbers.

Every choice depends only on a row's id and a seed, so retried tasks and other partitionings pick
the same rows. Fixed-size choices read a narrow projection to find where each group's quota ends,
then keep rows by comparing with that one cutoff per group: wide rows are filtered, not shuffled.

``key`` overrides the seeded hash; it must be an integer spread evenly over ``[0, span)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lendlens.operators.ranks import key_cutoffs, match_on, rank_by_key, seeded_key, within_cutoff
from lendlens.shared import settle

#: Most classes that :func:`interleave` alternates; every row looks at all class sizes.
MAX_CLASSES = 1000
_SPAN = 1 << 31


def _order(id_column: str, seed: int, key: Column | None, span: int | None) -> tuple[Column, int]:
    return (seeded_key(id_column, seed), _SPAN) if key is None else (key, span)


def _keep(df: DataFrame, cutoffs: DataFrame, groups: Sequence[str], key: Column, id_column: str) -> DataFrame:
    if groups:
        joined = match_on(df, cutoffs, groups, "left")
    else:
        # ungrouped: at most one cutoff row
        limit = cutoffs.select(F.struct("keep_all", "cut_key", "cut_id").alias("c")).scalar()
        joined = df.withColumn("__c", limit).select(*df.columns, "__c.*")
    return joined.withColumn("__in", within_cutoff(key, id_column)).drop("keep_all", "cut_key", "cut_id")


def sample_n(
    df: DataFrame, n: int, id_column: str, seed: int = 42, key: Column | None = None, span: int | None = None
) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), the same ones for the same seed."""
    return sample_n_per_group(df, [], n, id_column, seed, key, span)


def sample_n_per_group(
    df: DataFrame,
    groups: Sequence[str],
    n: int,
    id_column: str,
    seed: int = 42,
    key: Column | None = None,
    span: int | None = None,
) -> DataFrame:
    """``n`` rows of every group: class-balanced samples, a fixed number per year."""
    k, s = _order(id_column, seed, key, span)
    cutoffs = key_cutoffs(df, k, id_column, s, F.lit(n), groups)
    return _keep(df, cutoffs, groups, k, id_column).filter("__in").drop("__in")


def hold_out_per_group(
    df: DataFrame,
    groups: Sequence[str],
    n: int,
    id_column: str,
    seed: int = 42,
    key: Column | None = None,
    span: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``n`` rows of every group, and all other rows. Both are filters of ``df``: no anti-join by id."""
    k, s = _order(id_column, seed, key, span)
    marked = _keep(df, key_cutoffs(df, k, id_column, s, F.lit(n), groups), groups, k, id_column)
    return marked.filter("__in").drop("__in"), marked.filter("not __in").drop("__in")


def sample_fraction_per_group(
    df: DataFrame,
    groups: Sequence[str],
    fraction: float,
    id_column: str,
    seed: int = 42,
    key: Column | None = None,
    span: int | None = None,
) -> DataFrame:
    """The first ``floor(fraction × rows)`` rows of every group."""
    k, s = _order(id_column, seed, key, span)
    cutoffs = key_cutoffs(df, k, id_column, s, F.col("total") * F.lit(fraction), groups)
    return _keep(df, cutoffs, groups, k, id_column).filter("__in").drop("__in")


def allocate(df: DataFrame, keys: Sequence[str], label: str, target: int) -> DataFrame:
    """Share of ``target`` per stratum, by its share of all rows, with the stratum's label rate."""
    counts = settle(
        df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("total_count"),
            F.count_if(F.col(label) == 1).alias("approved_count"),
            F.count_if(F.col(label) == 0).alias("denied_count"),
        )
    )
    everything = counts.agg(F.sum("total_count")).scalar()
    return counts.select(
        "*",
        (F.col("approved_count").cast("double") / F.col("total_count")).alias("approval_rate"),
        F.round(F.lit(float(target)) * (F.col("total_count").cast("double") / everything))
        .cast("bigint")
        .alias("sample_size_group"),
    )


def stratified_sample(
    df: DataFrame,
    strata: Sequence[str],
    label: str,
    target: int,
    id_column: str,
    seed: int = 42,
    key: Column | None = None,
    span: int | None = None,
) -> DataFrame:
    """Proportional sample of about ``target`` rows that keeps each stratum's approval rate."""
    k, s = _order(id_column, seed, key, span)
    size, rate = F.col("sample_size_group"), F.col("approval_rate")
    shares = allocate(df, strata, label, target)
    quotas = shares.select(
        *strata,
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("cls"), (size * rate).alias("quota")),
                F.struct(F.lit(0).alias("cls"), (size * (1 - rate)).alias("quota")),
            )
        ).alias("__q"),
    ).select(*strata, F.col("__q.cls").cast(df.schema[label].dataType).alias(label), "__q.quota")
    groups = [*strata, label]
    cutoffs = key_cutoffs(df, k, id_column, s, F.col("quota"), groups, quotas)
    return _keep(df, cutoffs, groups, k, id_column).filter("__in").drop("__in")


def split_stratified(
    df: DataFrame,
    strata: Sequence[str],
    test_fraction: float,
    id_column: str,
    seed: int = 42,
    key: Column | None = None,
    span: int | None = None,
) -> DataFrame:
    """Adds ``is_test``: true for the first ``floor(test_fraction × rows)`` rows of each stratum."""
    k, s = _order(id_column, seed, key, span)
    cutoffs = key_cutoffs(df, k, id_column, s, F.col("total") * F.lit(test_fraction), strata)
    return _keep(df, cutoffs, strata, k, id_column).withColumnRenamed("__in", "is_test")


def split_column(id_column: str, edges: Sequence[float] = (0.98, 0.99), seed: int = 42) -> Column:
    """Part number 0, 1, 2, … by where the row's seeded key falls between ``edges``."""
    u = seeded_key(id_column, seed) / F.lit(float(_SPAN))
    return sum((F.when(u >= e, 1).otherwise(0) for e in edges), F.lit(0)).alias("split")


def random_weight(id_column: str, seed: int = 42) -> Column:
    """Repeatable number in [0, 1) per row."""
    return (seeded_key(id_column, seed) / F.lit(float(_SPAN))).alias("sample_weight")


def strata_label(year: str, purpose: str, label: str) -> Column:
    return F.concat(F.col(year).cast("string"), F.lit("_"), F.col(purpose), F.lit("-"), F.col(label).cast("string"))


def assign_chunks(
    df: DataFrame,
    chunk_size: int,
    id_column: str,
    seed: int = 42,
    key: Column | None = None,
    span: int | None = None,
) -> DataFrame:
    """One random global order: ``global_row_number`` 1..n and ``chunk_number`` from 0."""
    k, s = _order(id_column, seed, key, span)
    numbered = rank_by_key(df, k, id_column, s, name="global_row_number")
    return numbered.withColumn(
        "chunk_number", F.floor((F.col("global_row_number") - 1) / F.lit(chunk_size)).cast("bigint")
    )


def interleave(
    df: DataFrame,
    label: str,
    chunk_size: int,
    id_column: str,
    seed: int = 42,
    key: Column | None = None,
    span: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Alternate the classes: first row of each class, then the second of each, and so on.

    With the rank inside the class and the class sizes known, the global number is arithmetic; no
    second sort is needed. ``limit`` keeps the first rows of that order. More than :data:`MAX_CLASSES`
    values of ``label`` raise an error.
    """
    k, s = _order(id_column, seed, key, span)
    ranked = rank_by_key(df, k, id_column, s, [label], "rn_within_class")
    counts = settle(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")))
    if counts.count() > MAX_CLASSES:
        raise ValueError(f"{label} has more than {MAX_CLASSES} values; it is not a class")
    # one small struct per class
    sizes = counts.agg(F.collect_list(F.struct(F.col(label).alias("cls"), "n"))).scalar()
    r = F.col("rn_within_class")
    ahead = F.aggregate(
        F.col("__sizes"),
        F.lit(0).cast("bigint"),
        lambda acc, c: acc
        + F.least(c["n"], r - 1)
        + F.when((c["cls"] < F.col(label)) & (c["n"] >= r), 1).otherwise(0),
    )
    numbered = ranked.withColumn("__sizes", sizes).withColumn("global_row_number", ahead + 1).drop("__sizes")
    if limit is not None:
        numbered = numbered.filter(F.col("global_row_number") <= limit)
    return numbered.withColumn(
        "chunk_number", F.floor((F.col("global_row_number") - 1) / F.lit(chunk_size)).cast("bigint")
    )
