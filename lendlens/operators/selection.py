"""Exact order statistics of large groups by refining histograms, without sorting or shuffling the values.

The values of a group lie in a range; a pass counts them in buckets of the range, combined on the map side, and
keeps the buckets that hold a wanted position, each with its least and largest value as the next range.
Buckets are of equal width, or of equal ratio where a range spans several magnitudes, so a few passes
lead to ranges with one value or few rows. Bucket numbers never fall as values rise, which is all that
exactness needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lendlens.shared import settle

BUCKETS = 4096
#: Rows of a range that are counted value by value.
FEW_ROWS = 10_000
_MOST_PASSES = 40


def _bucket(value: Column, lo: Column, hi: Column) -> Column:
    """Number of a value's bucket in its range; infinities and NaN have buckets of their own."""
    linear = (value / 2 - lo / 2) / (hi / 2 - lo / 2)
    above = (F.log(value) - F.log(lo)) / (F.log(hi) - F.log(lo))
    below = (F.log(-lo) - F.log(-value)) / (F.log(-lo) - F.log(-hi))
    share = F.when((lo > 0) & (hi / 4 > lo), above).when((hi < 0) & (lo / 4 < hi), below).otherwise(linear)
    inside = F.greatest(F.lit(0), F.least(F.lit(BUCKETS - 1), F.floor(share * BUCKETS).cast("int")))
    by_sign = F.when(value < 0, 0).when(value == 0, 1).otherwise(2)
    crossing = (lo < 0) & (hi > 0)
    number = F.when(crossing, by_sign).otherwise(F.when(hi > lo, inside).otherwise(0))
    return (
        F.when(F.isnan(value), BUCKETS + 1)
        .when(value == float("inf"), BUCKETS)
        .when(value == float("-inf"), -1)
        .otherwise(number)
    )


def _finite(value: Column) -> Column:
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def _wanted(probs: Sequence[float], n: Column) -> Column:
    """Positions, counted from 0, whose values the quantiles lie between."""
    ends = [e for p in probs for e in (F.floor(F.lit(float(p)) * (n - 1)), F.ceil(F.lit(float(p)) * (n - 1)))]
    return F.array_distinct(F.array(*ends))


def cells(values: DataFrame, groups: Sequence[str], probs: Sequence[float], value: str = "value") -> DataFrame:
    """(groups, value, n, upto, upto_total): the values at the wanted positions of every group.

    ``n`` rows have the value, ``upto`` rows have it or a smaller one, ``upto_total`` is the group's size.
    Group columns must not be null; null values are left out. ``values`` is read once per pass, of which there
    are about four. Its groups should be few and large, since a pass keeps up to 4096 counts a group and
    range; there are at most two ranges per probability.
    """
    given = values.filter(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("value"))
    size = given.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.min(_finite(F.col("value"))).alias("lo"), F.max(_finite(F.col("value"))).alias("hi")
    )
    ranges = settle(
        size.select(
            *groups,
            F.lit(0).alias("range"),
            F.coalesce("lo", F.lit(0.0)).alias("lo"),
            F.coalesce("hi", F.lit(0.0)).alias("hi"),
            F.lit(float("-inf")).alias("least"),
            F.lit(float("nan")).alias("most"),
            F.lit(0).cast("bigint").alias("before"),
            "n",
            F.col("n").alias("upto_total"),
            _wanted(probs, F.col("n")).alias("wanted"),
        )
    )
    keys = [*groups, "range"]
    done: list[DataFrame] = []
    for _ in range(_MOST_PASSES):
        inside = given.join(ranges, list(groups)).filter(F.col("value").between(F.col("least"), F.col("most")))
        placed = inside.select(*keys, "value", _bucket(F.col("value"), F.col("lo"), F.col("hi")).alias("bucket"))
        counts = placed.groupBy(*keys, "bucket").agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most")
        )
        earlier = W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # at most 4099 rows
        laid = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        known = ranges.select(*keys, F.col("before").alias("__base"), "upto_total", "wanted")
        laid = laid.join(known, keys).withColumn("before", F.col("before") + F.col("__base"))
        mine = F.filter("wanted", lambda p: (p >= F.col("before")) & (p < F.col("before") + F.col("n")))
        held = laid.withColumn("wanted", mine).filter(F.size("wanted") > 0)
        # ranges are numbered anew, at most two a probability
        number = F.row_number().over(W.partitionBy(*groups).orderBy("range", "bucket")) - 1
        held = settle(
            held.select(
                *groups,
                number.alias("range"),
                F.col("least").alias("lo"),
                F.col("most").alias("hi"),
                "least",
                "most",
                "before",
                "n",
                "upto_total",
                "wanted",
            )
        )
        single = F.col("lo") == F.col("hi")
        done.append(held.filter(single).select(*groups, F.col("lo").alias("value"), "n", (F.col("before") + F.col("n")).alias("upto"), "upto_total"))
        done.append(_by_value(given, held.filter(~single & (F.col("n") <= FEW_ROWS)), groups))
        ranges = held.filter(~single & (F.col("n") > FEW_ROWS))
        if ranges.isEmpty():
            break
    else:
        raise RuntimeError("ranges did not settle")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def _by_value(given: DataFrame, few: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Cells of the wanted positions in ranges of few rows, by counting every value of them."""
    inside = given.join(few, list(groups)).filter(F.col("value").between(F.col("least"), F.col("most")))
    keys = [*groups, "before", "upto_total", "wanted"]
    counted = inside.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(W.partitionBy(*groups, "before").orderBy("value")) + F.col("before")  # at most FEW_ROWS rows
    laid = counted.withColumn("upto", upto)
    hit = F.exists("wanted", lambda p: (p < F.col("upto")) & (p >= F.col("upto") - F.col("n")))
    return laid.filter(hit).select(*groups, "value", "n", "upto", "upto_total")
