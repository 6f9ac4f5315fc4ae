"""Numeric helpers: guarded logs and ratios, winsorising, intervals, bins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def share_pct(x: Column, total: Column, digits: int = 2) -> Column:
    """``x`` as a percentage of ``total``; null when the total is not positive."""
    return F.when(total > 0, F.round(x / total * 100, digits))


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient as double, null for a zero denominator."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def safe_log1p(c: Column) -> Column:
    """ln(1+x) with missing and impossible values as 0."""
    x = c.cast("double")
    return F.when(x > -1, F.log1p(x)).otherwise(0.0)


def missing_flag(c: Column) -> Column:
    return c.isNull().cast("int")


def present_flag(c: Column) -> Column:
    return c.isNotNull().cast("int")


def winsorise(c: Column, low: Column, high: Column) -> Column:
    """Clip to [low, high]; a missing value becomes the lower cap."""
    return F.coalesce(F.least(F.greatest(c.cast("double"), low), high), low)


def scaled(c: Column, factor: float) -> Column:
    return c * F.lit(factor)


def wald_interval(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    half = z * F.sqrt(p * (1 - p) / F.nullif(n.cast("double"), F.lit(0.0)))
    return p - half, p + half


def wilson_interval(p: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    m = F.nullif(n.cast("double"), F.lit(0.0))
    centre = (p + z * z / (2 * m)) / (1 + z * z / m)
    half = z / (1 + z * z / m) * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    return centre - half, centre + half


def equal_bin(c: Column, low: float, high: float, bins: int) -> Column:
    """1-based equal-width bin; below ``low`` is 0 and from ``high`` on is ``bins`` + 1."""
    return F.width_bucket(c, F.lit(float(low)), F.lit(float(high)), F.lit(bins)).cast("int")


def stepped(c: Column, steps: Sequence[tuple[float, str]], last: str | None) -> Column:
    """Label of the first step whose bound is above the value; ``last`` beyond all of them."""
    out = None
    for bound, label in steps:
        out = F.when(c < bound, label) if out is None else out.when(c < bound, label)
    return out.otherwise(last)


def quartile_label(c: Column, cuts: Sequence[Column]) -> Column:
    """Low / Med-Low / Med-High / High against three cut points."""
    q1, q2, q3 = cuts
    return F.when(c < q1, "Low").when(c < q2, "Med-Low").when(c < q3, "Med-High").otherwise("High")


def calendar_years(start: Column, end: Column) -> Column:
    """Difference of calendar years, not elapsed years."""
    return F.year(end) - F.year(start)
