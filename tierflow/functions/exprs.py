"""Small column expressions. All of them stay inside whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero_trim(c: Column | str) -> Column:
    """Identifier without its leading zeros."""
    return F.ltrim(_col(c), F.lit("0"))


def div0(num: Column | str, den: Column | str) -> Column:
    """Quotient, 0 where the divisor is 0, null where the divisor is null."""
    num, den = _col(num).cast("double"), _col(den).cast("double")
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def div0null(num: Column | str, den: Column | str) -> Column:
    """Quotient, 0 where the divisor is 0 or null."""
    num, den = _col(num).cast("double"), _col(den).cast("double")
    return F.when(den.isNull() | (den == 0), F.lit(0.0)).otherwise(num / den)


def previous_weekday(c: Column, day: str) -> Column:
    """Last given weekday strictly before the date."""
    return F.date_sub(F.next_day(F.date_sub(c, 1), day), 7)


def next_weekday(c: Column, day: str) -> Column:
    """First given weekday strictly after the date."""
    return F.next_day(c, day)


def text(c: Column | str) -> Column:
    """Trimmed text, the empty string for null."""
    return F.coalesce(F.trim(_col(c)), F.lit(""))
