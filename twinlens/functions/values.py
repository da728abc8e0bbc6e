"""Value cleaning shared by readers and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts longer than this are compared by digest so that no shuffle carries them.
LONG_TEXT = 64


def text_key(df: DataFrame, column: str) -> Column:
    """Column as text that is equal exactly when the values are equal.

    Long texts are replaced by their 256-bit digest: counting distinct web pages
    then moves 64 bytes per page, not the page.
    """
    text = F.col(column).cast("string")
    if isinstance(df.schema[column].dataType, T.StringType):
        return F.when(F.length(text) > LONG_TEXT, F.sha2(text, 256)).otherwise(text)
    return text


def as_number(column: Column) -> Column:
    """Lenient numeric coercion: bad values and NaN become NULL."""
    return F.nanvl(column.try_cast("double"), F.lit(None).cast("double"))


def numeric_or_epoch(df: DataFrame, column: str) -> Column:
    """Double view of a numeric or date column (dates as epoch seconds)."""
    if isinstance(df.schema[column].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.col(column).cast("timestamp").cast("double")
    return as_number(F.col(column))


def finite_or_null(column: Column) -> Column:
    """NaN and infinities become NULL so that JSON output stays valid."""
    inf = float("inf")
    return F.when(~(F.isnan(column) | column.isin(inf, -inf)), column)


def clip(column: Column, low: float, high: float) -> Column:
    return F.when(column.isNotNull(), F.least(F.greatest(column, F.lit(low)), F.lit(high)))


def printed(value: Column, digits: int) -> Column:
    """``value`` with so many decimals, rounded as C's printf does: by its exact binary value, ties to even.

    ``format_string`` rounds the shortest decimal spelling instead: 0.6625, a little less in
    binary, would give 0.663. Values of 2^52 / 10^digits and more have no such decimals to round.
    """
    scale, size = 2.0 * 10**digits, F.abs(value)
    high = size * F.lit(134217729.0) - (size * F.lit(134217729.0) - size)  # the upper 26 bits
    twice = size * F.lit(scale)
    error = (high * F.lit(scale) - twice) + (size - high) * F.lit(scale)  # twice + error is exact
    below = F.floor(twice / 2).cast("double")
    rest = (twice - 2 * below) + error
    up = (rest > 1) | ((rest == 1) & (F.pmod(below, F.lit(2.0)) == 1))
    nearest = (below + F.when(up, 1).otherwise(0)) / F.lit(scale / 2)
    exact = F.when(size < 2**52 / scale, nearest).otherwise(size)
    return F.concat(F.when(value < 0, "-").otherwise(""), F.format_string(f"%.{digits}f", exact))


def nearest(value: Column, digits: int) -> Column:
    """``value`` rounded to so many decimals as the SQL rounds: scaled first, then to a whole number.

    ``round`` goes by the shortest decimal spelling: 0.00015 gives 0.0002, though scaled it is below 1.5.
    """
    scale = F.lit(10.0**digits)
    return F.round(value * scale) / scale
