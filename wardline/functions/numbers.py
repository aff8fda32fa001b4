"""Column functions on numbers and counts written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNT_PATTERN = r"^([0-9]+|[0-9]{1,3}(,[0-9]{3})*)$"


def rounded(c: Column, digits: int = 6) -> Column:
    """Half up on the double itself; the same in engines that round differently."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def count_of(text: Column, most: int = 9_999_999) -> Column:
    """The count that a text states (digits, or groups of three), else null."""
    trimmed = F.trim(text, F.lit(" \t"))
    number = F.when(trimmed.rlike(COUNT_PATTERN), F.regexp_replace(trimmed, ",", "").try_cast("bigint"))
    return F.when(number <= most, number.cast("int"))


def hour_of(minutes: Column) -> Column:
    """Hour of the day of minutes since midnight of the first day."""
    return F.pmod(F.floor(minutes / 60), F.lit(24)).cast("int")


def survival(elapsed: Column, golden: float, decay: float) -> Column:
    """Share that survives after ``elapsed`` minutes: 1 within the golden time, then exponential decay."""
    return F.exp(-F.lit(decay) * F.greatest(F.lit(0.0), elapsed - golden))


def band(value: Column, width: int, low: float, high: float, top: float) -> Column:
    """Label of a value's band: missing, outlier outside low..high, ``top+``, else ``a-b``."""
    start = (F.floor(value / width) * width).cast("int")
    return (
        F.when(value.isNull(), "missing")
        .when((value < low) | (value > high), "outlier")
        .when(value >= top, F.lit(f"{int(top)}+"))
        .otherwise(F.concat(start.cast("string"), F.lit("-"), (start + (width - 1)).cast("string")))
    )


def clamp(c: Column, low: float, high: float) -> Column:
    """Within the bounds; null stays null."""
    return F.when(c < low, low).when(c > high, high).otherwise(c)


def uniform(key: Column) -> Column:
    """A number from 0 to below 1 drawn from the key, the same in every run: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0
