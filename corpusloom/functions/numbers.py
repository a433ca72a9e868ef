"""Numbers as reports print them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPLIT = 134217729.0  # 2^27 + 1: parts a double into halves whose products are exact


def _halves(x: Column) -> tuple[Column, Column]:
    high = x * SPLIT - (x * SPLIT - x)
    return high, x - high


def rounded(x: Column, digits: int) -> Column:
    """``x`` rounded to ``digits`` places by its exact binary value, ties to even.

    Spark's round and bround go by the shortest decimal that names a double:
    2.675 is a tie for them, while its value lies below 2.675.  Here a product
    that seems to be a tie is decided by its exact error.  Null, NaN and infinite
    values stay, as do those of 2^52 and more in units of the last place; a zero keeps its sign.
    """
    scale = 10.0**digits
    p = x * scale
    (a, b), (c, d) = _halves(x), _halves(F.lit(scale))
    error = ((a * c - p) + a * d + b * c) + b * d
    # The floor as a double; Spark's own is a long.
    low = F.rint(p - 0.5)
    low = F.when(low > p, low - 1).when(low + 1 <= p, low + 1).otherwise(low)
    part = p - low
    up = (part > 0.5) | ((part == 0.5) & ((error > 0) | ((error == 0) & (F.abs(low) % 2 == 1))))
    whole = F.when(up, low + 1).otherwise(low)
    return F.when(F.isnan(x) | (F.abs(p) >= 2.0**52), x).when(whole == 0, x * 0.0).otherwise(whole / scale)


def rate(count: Column, seconds: Column) -> Column:
    """Units a second; no time counts as a microsecond."""
    return count / F.greatest(seconds, F.lit(1e-6))
