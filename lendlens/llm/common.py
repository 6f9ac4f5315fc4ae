"""Column helpers that several training-data operators share."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space between words for the rules that count words of any kind.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Everything that is not a lower-case letter, digit or non-ASCII character.
NON_WORD_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def or_empty(text: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone; all-ASCII texts take the fast built-in."""
    only_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(only_ascii, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def split_words(text: Column, gap: str) -> Column:
    """Words of a non-null text: the non-empty pieces between runs of ``gap``."""
    return F.array_remove(F.split(text, gap), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it.

    The optimizer may copy the definition of a column into every place that reads it, inner loops of
    ``transform`` included; a lambda variable stays one value.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unit_hash(*parts: Column) -> Column:
    """Repeatable number in [0, 1) from 52 bits of the MD5 of the joined parts."""
    digest = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint").cast("double") / float(1 << 52)
