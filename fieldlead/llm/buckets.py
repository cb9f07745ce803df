"""Order-preserving codes of numbers in a bounded universe; they stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def log_bucket(value: Column, mantissa_bits: int) -> Column:
    """Order-preserving integer code of a double: sign, binary exponent, leading mantissa bits.

    The universe is bounded (about 2^(12 + mantissa_bits) codes) whatever the data are. Codes are
    monotone in the value and the lower edge of a code differs from every value in it by at most a
    factor of 2^-mantissa_bits. Zero, and anything smaller than 2^-1000, has code 0. Nulls and NaN
    give null.
    """
    x = value.cast("double")
    a = F.abs(x)
    guess = F.floor(F.log2(a))
    # log2 may round up or down next to a power of two; both sides are put right exactly
    exponent = guess + F.when(F.pow(F.lit(2.0), guess) > a, -1).when(F.pow(F.lit(2.0), guess + 1) <= a, 1).otherwise(0)
    steps = float(1 << mantissa_bits)
    mantissa = F.floor((a / F.pow(F.lit(2.0), exponent) - F.lit(1.0)) * F.lit(steps))
    code = (exponent + F.lit(1001)) * F.lit(1 << mantissa_bits) + mantissa
    tiny = F.lit(2.0**-1000)
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(None))
        .when(a < tiny, F.lit(0))
        .when(a == F.lit(float("inf")), F.signum(x) * F.lit(2025 << mantissa_bits))
        .otherwise(F.signum(x) * code)
        .cast("bigint")
    )


def bucket_floor(code: Column, mantissa_bits: int) -> Column:
    """The value of smallest magnitude that has this code; inverse of ``log_bucket``."""
    steps = 1 << mantissa_bits
    a = F.abs(code)
    exponent = F.floor(a / F.lit(steps)) - F.lit(1001)
    mantissa = F.pmod(a, F.lit(steps))
    return F.when(a == 0, F.lit(0.0)).otherwise(
        F.signum(code.cast("double")) * F.pow(F.lit(2.0), exponent.cast("double")) * (F.lit(1.0) + mantissa / F.lit(float(steps)))
    )
