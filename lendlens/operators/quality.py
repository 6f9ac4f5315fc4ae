"""Data-quality checks that return the offending rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from lendlens.shared import settle

#: Hash buckets by which two tables are compared before their rows are.
DIFF_BUCKETS = 4096


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def check_not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def rows_with_nulls(df: DataFrame, columns: Sequence[str] | None = None, ignore: Sequence[str] = ()) -> DataFrame:
    """Rows with a null in any of the columns."""
    checked = [c for c in columns or df.columns if c not in ignore]
    return df.filter(reduce(or_, [F.col(c).isNull() for c in checked]))


def assert_same_count(before: DataFrame, after: DataFrame) -> None:
    a, b = before.count(), after.count()
    if a != b:
        raise AssertionError(f"row count changed from {a} to {b}")


def set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` lacks."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def assert_covered(a: DataFrame, b: DataFrame, key: str) -> None:
    if not set_difference(a, b, key).isEmpty():
        raise AssertionError(f"some values of {key} are not covered")


def differing_buckets(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str], buckets: int = DIFF_BUCKETS) -> DataFrame:
    """Numbers (``__bucket``) of the hash buckets of the key whose rows are not the same on both sides.

    A bucket's rows are summed up by their number and by a sum and an exclusive or of 64-bit row hashes, which do not
    depend on the order and are combined on the map side.
    """

    def digests(df: DataFrame, side: str) -> DataFrame:
        # the hash passes over nulls, so where they are is hashed too
        parts = [x for c in [key, *columns] for x in (F.col(c).isNull(), F.col(c))]
        one, two = F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)
        summed = F.struct(F.count(F.lit(1)), F.sum(one.cast("decimal(20,0)")), F.bit_xor(two))
        return df.groupBy(_bucket(key, buckets).alias("__bucket")).agg(summed.alias(side))

    both = digests(a, "one").join(digests(b, "two"), "__bucket", "full_outer")
    return both.filter(~F.col("one").eqNullSafe(F.col("two"))).select("__bucket")


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets))


def diff_tables(a: DataFrame, b: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows missing on one side or unequal, with the names of the differing columns.

    Only rows of buckets whose digests differ are joined, so tables that are almost equal move next to nothing.
    """
    columns = [c for c in columns or a.columns if c != key]
    apart = settle(differing_buckets(a, b, key, columns))
    a, b = (df.withColumn("__bucket", _bucket(key, DIFF_BUCKETS)).join(apart, "__bucket", "left_semi") for df in (a, b))
    left = a.select(F.col(key), *[F.col(c).alias(f"a_{c}") for c in columns], F.lit(True).alias("__a"))
    right = b.select(F.col(key), *[F.col(c).alias(f"b_{c}") for c in columns], F.lit(True).alias("__b"))
    both = left.join(right, key, "full_outer")
    status = F.when(F.col("__b").isNull(), "only_in_a").when(F.col("__a").isNull(), "only_in_b").otherwise("changed")
    changed = F.filter(
        F.array(
            *[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in columns]
        ),
        lambda x: x.isNotNull(),
    )
    return both.select(key, status.alias("status"), F.array_join(changed, ",").alias("changed_columns")).filter(
        (F.col("status") != "changed") | (F.col("changed_columns") != "")
    )
