"""Exact medians per site and column: of bounded buffers, and by radix selection.

Sites of at most ``DIRECT`` rows, most often all, take Spark's exact percentile in one
aggregate, whose buffers hold at most that many values a column.  Larger sites are found
by counting the rows, and only their rows take the rounds of the selection:

A value is a sortable long of 64 bits (``functions.radix``).  A round counts, for each
site and column, the values by the next digit of their long, among those that share the
digits found so far; running counts over the digits give the digit that holds a middle
rank.  Three rounds of 20, 22 and 22 bits know the value; a group that holds one value
only is done before, and when no group has more than 2**22 values the next round takes
all their bits.  All columns take part in the same rounds.

The counts are combined map side, and they are spread by site, column and digit, so a
site with a third of all rows is no task's group.  What a task holds at once are the
digits of one site and column, at most 2**22 short rows, whatever the number of events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigwin.functions.radix import prefix, with_sortable_long
from sigwin.operators.joins import broadcast_if_small
from sigwin.session import stored

#: Leading bits that are known after each round, and digits of a group that a round counts at most.
ROUNDS = (20, 42, 64)
DIGITS = 1 << 22
#: Rows of a site whose median may come from a buffer of its values.
DIRECT = 4096


def long_values(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """``(keys, c, x, key)``: the non-NULL values of the columns, one row each; ``c`` is the column's number."""
    rows = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("x")) for i, c in enumerate(columns)])
    return with_sortable_long(df.select(*keys, F.inline(rows)).where(F.col("x").isNotNull()), "x")


def histogram(values: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """``(keys, c, digits, n, low, high)``: values and their range by their leading ``bits`` bits."""
    return values.groupBy(*keys, "c", prefix(F.col("key"), bits).alias("digits")).agg(
        F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))


def _holders(counts: DataFrame, keys: list[str], known: str | None, ranks: list) -> DataFrame:
    """The digits that hold a wanted rank; ``lower`` and ``upper`` become ranks among their values."""
    group = [*keys, "c", *([known] if known else [])]
    before = Window.partitionBy(*group).orderBy("digits").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    lower, upper = ranks
    within = [(r - F.col("_before")).alias(name) for r, name in ((lower, "lower"), (upper, "upper"))]
    held = counts.select(*keys, "c", "digits", "n", "low", "high", *within)
    inside = [F.when(F.col(name).between(0, F.col("n") - 1), F.col(name)).alias(name) for name in ("lower", "upper")]
    return (held.select(*keys, "c", "digits", "n", "low", "high", *inside)
            .where(F.col("lower").isNotNull() | F.col("upper").isNotNull()))


def middle_values(df: DataFrame, keys: list[str], columns: list[str], rounds: tuple = ROUNDS) -> DataFrame:
    """``(keys, c, low, lower, upper)``: the values at ranks floor and ceil of (n - 1) / 2.

    A row whose ``lower`` (``upper``) is not NULL has the lower (upper) middle value in ``low``.
    """
    values, found, open_groups, known, bits = long_values(df, keys, columns), None, None, 0, rounds[0]
    while True:
        if open_groups is None:
            counts = histogram(values, keys, bits)
            total = F.sum("n").over(Window.partitionBy(*keys, "c"))
            counts = counts.withColumn("_all", total)
            middle = [F.expr("(_all - 1) DIV 2"), F.expr("_all DIV 2")]
            held = _holders(counts, keys, None, middle)
        else:
            wanted = broadcast_if_small(open_groups.select(
                *keys, "c", F.col("digits").alias("_known"), F.col("lower").alias("_lower"),
                F.col("upper").alias("_upper")), name="median-groups")
            inside = values.withColumn("_known", prefix(F.col("key"), known)).join(wanted, [*keys, "c", "_known"])
            counts = (inside.groupBy(*keys, "c", "_known", prefix(F.col("key"), bits).alias("digits")).agg(
                F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"),
                F.first("_lower").alias("_lower"), F.first("_upper").alias("_upper")))
            held = _holders(counts, keys, "_known", [F.col("_lower"), F.col("_upper")])
        held = stored(held, "median-digits")
        single = F.col("low") == F.col("high")
        done = held.where(single).select(*keys, "c", "low", "lower", "upper")
        found = done if found is None else found.unionByName(done)
        open_groups, known = held.where(~single), bits
        largest = open_groups.agg(F.max("n")).first()[0] if known < 64 else None
        if largest is None:
            return found
        bits = 64 if largest <= DIGITS else min(b for b in rounds if b > known)


def selected_medians(df: DataFrame, keys: list[str], columns: list[str], names: list[str]) -> DataFrame:
    """``exact_medians`` by radix selection, whatever the number of a site's rows."""
    parts = middle_values(df, keys, columns)
    aggs = []
    for i in range(len(columns)):
        for rank in ("lower", "upper"):
            held = (F.col("c") == i) & F.col(rank).isNotNull()
            aggs.append(F.max(F.when(held, F.col("low"))).alias(f"_{rank}_{i}"))
    sides = parts.groupBy(*keys).agg(*aggs)
    medians = []
    for i, name in enumerate(names):
        a, b = F.col(f"_lower_{i}"), F.col(f"_upper_{i}")
        medians.append(F.when(a == b, a).otherwise(F.lit(0.5) * a + F.lit(0.5) * b).alias(name))
    return sides.select(*keys, *medians)


def exact_medians(df: DataFrame, keys: list[str], columns: list[str], names: list[str], direct: int | None = None
                  ) -> DataFrame:
    """One row for each site with a value: the exact median of every column under its name, NULLs skipped.
    Even counts: half the lower plus half the upper middle value, as Spark's percentile."""
    direct = min(DIRECT, DIGITS) if direct is None else direct
    if direct < 1:
        return selected_medians(df, keys, columns, names)
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    large = broadcast_if_small(rows.where(F.col("n") > direct).select(*keys), name="large-sites")
    any_large = not large.isEmpty()
    small = df.join(large, keys, "left_anti") if any_large else df
    found = small.groupBy(*keys).agg(*[
        F.percentile(F.col(c).cast("double"), F.lit(0.5)).alias(name) for c, name in zip(columns, names, strict=True)])
    found = found.where(F.coalesce(*names).isNotNull())
    if not any_large:
        return found
    return found.unionByName(selected_medians(df.join(large, keys, "left_semi"), keys, columns, names))
