"""Row accounting by observed metrics: counts taken while a job reads or writes the rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class RowCounts:
    """Named counts of rows that pass a place of a plan.

    ``watch`` adds the counts to a frame; the first job that runs the frame fills them, and
    no job is run for them.  Place them where a job passes once: below a global sort Spark
    reads the rows twice to find its ranges.  A task that is run again after a lost executor
    can be counted again where its rows go to a shuffle.
    """

    def __init__(self) -> None:
        self._seen: list[tuple[Observation, dict[str, str]]] = []

    def watch(self, df: DataFrame, **counts: Column | bool) -> DataFrame:
        """``df``; for each name the rows of which the condition holds are counted."""
        seen = Observation(f"rows-{uuid.uuid4().hex}")
        names = {f"c{i}": name for i, name in enumerate(counts)}
        self._seen.append((seen, names))
        return df.observe(seen, *[F.count(F.when(F.lit(c), 1)).alias(f"c{i}") for i, c in enumerate(counts.values())])

    def add(self, seen: Observation, names: list[str]) -> None:
        self._seen.append((seen, {n: n for n in names}))

    def values(self) -> dict[str, int]:
        """The counts; waits for jobs that are still to fill them."""
        return {name: seen.get.get(alias, 0) for seen, names in self._seen for alias, name in names.items()}

    def table(self, spark: SparkSession) -> DataFrame:
        """``(item, n)``, one row a count."""
        return spark.createDataFrame(list(self.values().items()), "item string, n long")


def watch(df: DataFrame, rows: RowCounts | None, **counts: Column | bool) -> DataFrame:
    """``df``, watched where there is something to count into."""
    return df if rows is None else rows.watch(df, **counts)
