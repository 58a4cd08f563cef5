"""Exact running sums over values of any distribution, by ranges of bounded size.

Values are sortable longs (``functions.radix``).  A range is the set of values that
share leading bits.  It starts with ``STEPS[0]`` bits; a range with more than ``bound``
rows is split by the next bits, and its parts again, until each holds at most ``bound``
rows.  Rows of one range and group are one window; a range's offset is its parent's plus
the sums of the siblings before it, which are at most ``2 ** step`` short rows.  So no
task's share depends on how the values are spread or on how many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigwin.functions.radix import prefix, with_sortable_long
from sigwin.operators.joins import broadcast_if_small
from sigwin.session import stored

#: Leading bits of the ranges of each depth; with all 64 a range is one value.
STEPS = (12, 24, 36, 48, 64)
#: Rows of a group that share a range.
BOUND = 100_000


def _ordered(column: str, descending: bool) -> Column:
    return F.col(column).desc() if descending else F.col(column).asc()


def value_ranges(rows: DataFrame, key: str, sums: list[str], by: list[str], descending: bool, bound: int) -> DataFrame:
    """Stored ``(by, depth, digits, n, before_0, ...)``: the ranges, and the sums before each in its group.

    ``rows`` is read once for each depth that any range reaches, most often once or twice.
    """
    offsets = [f"before_{i}" for i in range(len(sums))]
    found = parents = None
    for depth, bits in enumerate(STEPS):
        totals = [F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"sum_{i}") for i, c in enumerate(sums)]]
        digits = prefix(F.col(key), bits).alias("digits")
        if parents is None:
            nodes = rows.groupBy(*by, digits).agg(*totals).withColumns({o: F.lit(0) for o in offsets})
            siblings = Window.partitionBy(*by)
        else:
            up = STEPS[depth - 1]
            known = [F.col(b).alias(f"_by_{i}") for i, b in enumerate(by)]
            side = broadcast_if_small(parents.select(*known, F.col("digits").alias("_up")), name="open-ranges")
            same = prefix(F.col(key), up) == F.col("_up")
            for i, b in enumerate(by):
                same = same & F.col(b).eqNullSafe(F.col(f"_by_{i}"))
            nodes = rows.join(side, same, "left_semi").groupBy(*by, digits).agg(*totals)
            nodes = nodes.withColumn("_up", F.shiftright("digits", bits - up))
            start = parents.select(*known, F.col("digits").alias("_parent"), *offsets)
            same = F.col("_up") == F.col("_parent")
            for i, b in enumerate(by):
                same = same & F.col(b).eqNullSafe(F.col(f"_by_{i}"))
            nodes = nodes.join(start, same).drop("_parent", *[f"_by_{i}" for i in range(len(by))])
            siblings = Window.partitionBy(*by, "_up")
        before = siblings.orderBy(_ordered("digits", descending)).rowsBetween(Window.unboundedPreceding, -1)
        nodes = nodes.select(*by, F.lit(depth).alias("depth"), "digits", "n", *[
            (F.col(o) + F.coalesce(F.sum(f"sum_{i}").over(before), F.lit(0))).alias(o) for i, o in enumerate(offsets)])
        nodes = stored(nodes, "ranges")
        full = (F.col("n") > bound) & F.lit(depth + 1 < len(STEPS))
        part = nodes.where(~full)
        found = part if found is None else found.unionByName(part)
        parents = nodes.where(full)
        if parents.isEmpty():
            break
    return found


def running_before(df: DataFrame, order_col: str, sum_cols: list[str], by: list[str] | None = None,
                   descending: bool = True, bound: int = BOUND) -> DataFrame:
    """For each row, the sums of ``sum_cols`` over the rows of its group (``by``) strictly before it
    in the order of ``order_col`` (values unique within a group), as ``<col>_before``."""
    by = list(by or [])
    values = df.withColumn("_value", F.col(order_col).cast("double"))
    rows = stored(with_sortable_long(values, "_value", "_key").drop("_value"), "ordered-values")
    ranges = value_ranges(rows, "_key", sum_cols, by, descending, bound)
    depths = [r["depth"] for r in ranges.select("depth").distinct().collect()]
    side = ranges.select(*[F.col(b).alias(f"_by_{i}") for i, b in enumerate(by)], F.col("depth").alias("_depth"),
                         F.col("digits").alias("_digits"), *[f"before_{i}" for i in range(len(sum_cols))])
    side = broadcast_if_small(side, name="ranges")
    # A row is in exactly one range, of some depth; most often all ranges have the same.
    places = F.array(*[F.struct(F.lit(d).alias("_at"), prefix(F.col("_key"), STEPS[d]).alias("_place"))
                       for d in sorted(depths)]) if depths else None
    if places is None:
        return rows.select(*df.columns, *[F.lit(0).cast("long").alias(f"{c}_before") for c in sum_cols])
    same = (F.col("_at") == F.col("_depth")) & (F.col("_place") == F.col("_digits"))
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{i}"))
    joined = rows.select(*df.columns, "_key", F.inline(places)).join(side, same)
    inside = (Window.partitionBy(*by, "_depth", "_digits").orderBy(_ordered("_key", descending))
              .rowsBetween(Window.unboundedPreceding, -1))
    return joined.select(*df.columns, *[
        (F.col(f"before_{i}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_before")
        for i, c in enumerate(sum_cols)])
