"""Text and code clean-up as built-in column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# Spellings that mean "no value" in application files.
CSV_NULL_TOKENS = ["NA", "na", "NaN", "nan", "Exempt", "exempt", "EXEMPT"]
TEXT_NULL_TOKENS = ["", "nan", "null", "none", "na", "n/a", "exempt", ".", "-", "unknown"]
NUMBER_NULL_TOKENS = ["nan", "NaN", "NAN", "NA", "Exempt", "None", "null", ""]


def null_if_in(c: Column, tokens: Sequence[str]) -> Column:
    """Null when the whole value is one of ``tokens``."""
    return F.when(~c.isin(list(tokens)), c)


def clean_text(c: Column, case: str | None = "lower", replacements: Mapping[str, str] | None = None) -> Column:
    """Trim, drop no-value spellings (whole value, any case), then lower- or title-case."""
    trimmed = F.trim(c)
    out = F.when(~F.lower(trimmed).isin(TEXT_NULL_TOKENS), trimmed)
    if case == "lower":
        out = F.lower(out)
    elif case == "title":
        out = F.initcap(out)
    if replacements:
        pairs = F.create_map(*[F.lit(x) for kv in replacements.items() for x in kv])
        out = F.coalesce(pairs[out], out)
    return out


def clean_number(c: Column, allow_negative: bool = True) -> Column:
    """Trimmed text as double; anything unparseable, and optionally any negative, is null."""
    out = null_if_in(F.trim(c.cast("string")), NUMBER_NULL_TOKENS).try_cast("double")
    return out if allow_negative else F.when(out >= 0, out)


def to_whole(c: Column, kind: str = "bigint") -> Column:
    """Text to a whole number, rounding ``'1.5'`` to 2 as the source warehouse does."""
    return F.round(c.try_cast("double")).try_cast(kind)


def not_exempt(c: Column) -> Column:
    """Null for any casing of ``Exempt``."""
    return F.when(~c.ilike("exempt"), c)


def pad_code(c: Column, width: int) -> Column:
    """Zero-pad on the left; longer input is cut on the right, which drops a trailing ``.0``."""
    return F.lpad(c, width, "0")


def whole_code(c: Column, width: int) -> Column:
    """Numeric text to a zero-filled code: ``'1.0'`` to ``'01'``; unparseable is null."""
    return F.lpad(c.try_cast("double").try_cast("bigint").cast("string"), width, "0")


def fips_tract(state: Column, county: Column, tract: Column) -> Column:
    """Eleven-digit tract id from its parts; null when any part is not a number."""
    return F.concat(
        whole_code(state, 2), whole_code(county, 3), whole_code(F.regexp_replace(tract, "[.]", ""), 6)
    )


def tract_text(c: Column) -> Column:
    """``'37057061600.0'`` to ``'37057061600'``; null when not a number."""
    return c.try_cast("double").try_cast("bigint").cast("string")


def percent_number(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), "%", "").try_cast("double")


def part(c: Column, sep: str, n: int) -> Column:
    """n-th piece (from 1) of separated text, empty when absent."""
    return F.split_part(c, F.lit(sep), F.lit(n))


def surrogate_key(columns: Sequence[str]) -> Column:
    """md5 over the dash-joined values, a missing value counting as empty text."""
    return F.md5(F.concat_ws("-", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def joined_label(*parts: Column, sep: str = "_", missing: str = "Unknown") -> Column:
    return F.concat_ws(sep, *[F.coalesce(p.cast("string"), F.lit(missing)) for p in parts])


def swap_group(label: Column, old: Column, new: Column) -> Column:
    """Replace a group's name inside an interaction label."""
    return F.replace(label, old, new)
