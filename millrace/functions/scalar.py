"""Column expressions that several operators use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column, digits: int | None = None) -> Column:
    """a / b, and 0 where b is 0 or the quotient is null."""
    q = F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return q if digits is None else F.round(q, digits)


def finite(x: Column) -> Column:
    """Whether a double is a number and not infinite; false for null."""
    return F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))


def whole_match(x: Column, pattern: str) -> Column:
    """Whether a pattern matches the whole string; `$` alone would accept a line end after it."""
    return x.rlike(rf"\A(?:{pattern})\z")


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also for null)."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0)).cast("long")


def hash_fraction(text: Column) -> Column:
    """The first 8 bytes of SHA-256 of a string as a fraction of 2^64, in [0, 1)."""
    first = F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return first.cast("double") / float(2**64)


def hash_order(*columns: Column) -> Column:
    """A fixed pseudo-random order: SHA-256 of the columns joined by a bar."""
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in columns]), 256)


def matches_season(x: Column, first_year: int = 1992) -> Column:
    """Whether a string is a season like 2024-25: two consecutive years from `first_year` on."""
    a, b = F.regexp_extract(x, r"\A([0-9]{4})-([0-9]{2})\z", 1), F.regexp_extract(x, r"\A([0-9]{4})-([0-9]{2})\z", 2)
    year = F.when(a != "", a.cast("int"))
    return F.coalesce((year >= first_year) & ((year + 1) % 100 == F.when(b != "", b.cast("int"))), F.lit(False))
