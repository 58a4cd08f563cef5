"""Doubles as longs of the same order, cut into digits (built-in expressions only).

A positive double is its exponent and fraction one after the other, as in its bits; the
long of a negative one is the negative.  Both zeros are 0.  Powers of two and the
products and quotients by them are exact, so the long tells every two different
values apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FRACTION = 52
_ONE = float(1 << FRACTION)
#: Smallest normal and smallest positive double.
_NORMAL, _SMALLEST = 2.0 ** -1022, 5e-324
NAN_KEY, NULL_KEY = (1 << 63) - 1, -(1 << 63)


def with_sortable_long(df: DataFrame, column: str, name: str = "key") -> DataFrame:
    """``df`` with a long that orders as the double ``column`` does in Spark: NULL first, NaN last.

    Step by step, so that each part is computed once a row and the generated code stays small.
    """
    x, infinite = F.col(column), F.lit(float("inf"))
    size, normal, guess, near, exponent = (F.col(f"_{n}") for n in ("size", "normal", "guess", "near", "exponent"))
    df = df.withColumn("_size", F.abs(x))
    df = df.withColumn("_normal", F.when((size >= _NORMAL) & (size < infinite), size))
    df = df.withColumn("_guess", F.floor(F.greatest(F.least(F.log2(normal), F.lit(1023.0)), F.lit(-1022.0))).cast("int"))
    df = df.withColumn("_near", F.pow(F.lit(2.0), guess))
    # The logarithm is rounded: one step down or up makes the exponent exact.
    df = df.withColumn("_exponent", guess + F.when(normal < near, -1).when(normal / near >= 2.0, 1).otherwise(0))
    bits = ((exponent + 1022).cast("long") * F.lit(1 << FRACTION)
            + (normal / F.pow(F.lit(2.0), exponent) * F.lit(_ONE)).cast("long"))
    df = df.withColumn("_bits", F.when(size < _NORMAL, (size / F.lit(_SMALLEST)).cast("long"))
                       .when(size == infinite, F.lit(2047 << FRACTION).cast("long")).otherwise(bits))
    key = (F.when(x.isNull(), F.lit(NULL_KEY).cast("long")).when(F.isnan(x), F.lit(NAN_KEY).cast("long"))
           .when(x < 0, -F.col("_bits")).otherwise(F.col("_bits")))
    # Never NULL, so that a join on it adds no null test of the whole expression.
    return df.withColumn(name, F.coalesce(key, F.lit(NULL_KEY).cast("long"))).drop("_size", "_normal", "_guess", "_near", "_exponent", "_bits")


def prefix(key: Column, bits: int) -> Column:
    """The leading ``bits`` bits of a sortable long, in the same order."""
    return F.shiftright(key, 64 - bits)
