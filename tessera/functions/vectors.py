"""Vector and score columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance."""
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def distance_score(distance: Column) -> Column:
    return 1 / (1 + distance)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is null, empty or all zero, or the lengths differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fine = a.isNotNull() & b.isNotNull() & (F.size(a) > 0) & (F.size(a) == F.size(b))
    return F.when(fine, F.coalesce(F.try_divide(dot(a, b), norm), F.lit(0.0))).otherwise(F.lit(0.0))


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded half up at a decimal digit, by floor: the same in every engine."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / scale


def hashed_embedding(text: Column, dim: int) -> Column:
    """A deterministic unit vector of a text for offline use: bytes of its sha256, less 128, repeated over `dim`."""
    digest = F.sha2(F.coalesce(text, F.lit("")), 256)
    raw = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double") - 128)
    norm = F.sqrt(F.aggregate(raw, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(raw, lambda x: x / norm)


def recency(anchor: Column, now: Column, half_life_hours: float) -> Column:
    """0.5 to the age in half-lives; an anchor in the future counts as now."""
    hours = F.greatest(F.unix_micros(now.cast("timestamp")) - F.unix_micros(anchor.cast("timestamp")), F.lit(0)) / F.lit(3.6e9)
    return F.pow(F.lit(0.5), hours / F.lit(half_life_hours))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """0 to 1 within the range; 1 where all are equal."""
    return F.when(high == low, F.lit(1.0)).otherwise((value - low) / F.nullif(high - low, F.lit(0.0)))


def share_of_max(value: Column, low: Column, high: Column) -> Column:
    """1 where all are equal, min-max if any value is negative, else the share of the largest."""
    return F.when(high == low, F.lit(1.0)).when(low < 0, (value - low) / F.nullif(high - low, F.lit(0.0))).otherwise(value / F.nullif(high, F.lit(0.0)))


def component(x: Column) -> Column:
    """A part of a score as it is shown: four digits, halves to the even one."""
    return F.bround(x, 4)


def utc(time: Column) -> Column:
    """A time in a text as a timestamp; one without a zone counts as UTC, whatever the session's zone."""
    zoned = time.rlike("([zZ]|[+-][0-9]{2}:?[0-9]{2})$")
    return F.try_to_timestamp(F.when(zoned, time).otherwise(F.concat(time, F.lit("Z"))))
