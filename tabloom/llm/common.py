"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
_SPACE_CHARS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row.

    A lambda variable keeps an array from being built again for every element
    of a later higher-order function.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, as an array."""
    return F.array_remove(F.split(text, SPACES), "")


def word_chars(text: Column) -> Column:
    """Code points inside words."""
    return F.length(F.translate(text, _SPACE_CHARS, ""))


def unhashed(digest: Column) -> Column:
    """The top 53 bits of a 64-bit hash as a draw from [0, 1)."""
    return F.shiftrightunsigned(digest, 11).cast("double") * F.lit(2.0**-53)
