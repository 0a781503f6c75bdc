"""An order-preserving integer image of a double, computed with built-ins only.

The key of a non-negative double equals its IEEE-754 bit pattern; negative values are
mirrored.  Comparing keys is comparing numbers, so the high bits of a key are a bucket
that depends on the value alone: no sampling, no splitters, the same on every retry.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MANTISSA = 1 << 52
_SMALLEST = 2.0**-1022
_LARGEST = 1.7976931348623157e308


def order_key(value: Column) -> Column:
    """BIGINT key with ``order_key(a) < order_key(b)`` exactly when ``a < b``."""
    x = F.abs(value.cast("double"))
    guess = F.floor(F.log2(F.greatest(x, F.lit(_SMALLEST)))).cast("int")
    # log2 may be one off next to a power of two; the mantissa shows it
    m0 = x / F.pow(F.lit(2.0), guess.cast("double"))
    exp = guess + F.when(m0 >= 2.0, 1).when(m0 < 1.0, -1).otherwise(0)
    mant = x / F.pow(F.lit(2.0), exp.cast("double"))
    normal = (exp + 1023).cast("bigint") * F.lit(_MANTISSA).cast("bigint") + (
        (mant - 1.0) * float(_MANTISSA)
    ).cast("bigint")
    # x * 2^1022 * 2^52 keeps subnormals exact without leaving the double range
    tiny = (x * F.lit(2.0**1022) * float(_MANTISSA)).cast("bigint")
    infinite = F.lit(2047 * _MANTISSA).cast("bigint")
    bits = (
        F.when(x == F.lit(float("inf")), infinite).when(x < _SMALLEST, tiny).otherwise(normal)
    )
    return F.when(value < 0, -bits).otherwise(bits)


def high_bucket(key: Column) -> Column:
    """Top 21 bits: at most two million buckets for any data."""
    return F.shiftright(key, 43).cast("int")


def middle_bucket(key: Column) -> Column:
    """The next 21 bits; what is left inside one pair of buckets is 22 bits wide."""
    return (F.shiftright(key, 22).bitwiseAND(F.lit((1 << 21) - 1))).cast("int")


def log_bucket(value: Column) -> Column:
    """A bucket that never falls as the value grows, 512 to the octave; cheaper than bits of ``order_key``."""
    x = F.abs(value.cast("double"))
    steps = F.floor(F.log2(F.greatest(F.least(x, F.lit(_LARGEST)), F.lit(5e-324))) * 512) + F.lit(1075 * 512)
    bucket = F.when(x == 0, 0).when(x > _LARGEST, 2100 * 512).otherwise(steps).cast("int")
    return F.when(value < 0, -bucket).otherwise(bucket)
