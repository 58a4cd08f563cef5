"""Seeded shuffle, sampling and exact splits, without a one-task global sort.

Rows are ordered by ``shuffle_key`` (md5 of the row key and a seed), which is uniform,
and rows of one key by the number they get when they are stored.  The k-th row is found
by counts, in three passes over the stored rows: counts by the first digits of the key
(at most 16**5) give the group that holds it; counts of that group by whole key and by
the part of the row number that says which task wrote the row give the key and the
task; the rows of one key and task, at most one task's rows, give the row.  Rows are
then selected by comparing them with it, so a key that all rows share is cut exactly,
by counts, and its rows stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigwin.functions.columns import SHUFFLE_SEED, shuffle_key
from sigwin.session import stored

KEY = "shuffle_key"
#: Hexadecimal digits of the first counts: at most 16**5 groups.
DIGITS = 5
#: Low bits of a row number that count rows within a task.
WITHIN = 33


def with_shuffle_key(df: DataFrame, key_cols=("contig", "position"),
                     seed: int = SHUFFLE_SEED) -> DataFrame:
    return df.withColumn(KEY, shuffle_key(*key_cols, seed=seed))


def seeded_shuffle(df: DataFrame, key_cols=("contig", "position"),
                   seed: int = SHUFFLE_SEED) -> DataFrame:
    """Reproducible permutation: a distributed sort on the shuffle key."""
    return with_shuffle_key(df, key_cols, seed).orderBy(KEY)


def _numbered(df: DataFrame, key_cols, seed: int) -> DataFrame:
    """Stored rows with their shuffle key and a number that stays as it is."""
    return stored(with_shuffle_key(df, key_cols, seed).withColumn("_row", F.monotonically_increasing_id()), "numbered")


def _group_of_rank(counts: DataFrame, columns: list[str], rank: int):
    """The row of ``counts`` (columns, ``n``) that holds the 1-based rank in their order, with ``before``."""
    upto = Window.orderBy(*columns).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = counts.withColumn("before", F.sum("n").over(upto) - F.col("n"))
    return running.where((F.col("before") < rank) & (F.col("before") + F.col("n") >= rank)).first()


def first_counts(rows: DataFrame) -> DataFrame:
    """Pass 1: rows by the first digits of the key."""
    return rows.groupBy(F.substring(KEY, 1, DIGITS).alias("digits")).agg(F.count(F.lit(1)).alias("n"))


def kth_row(rows: DataFrame, k: int, counts: DataFrame) -> tuple[str, int] | None:
    """(key, row number) of the k-th (1-based) of the numbered rows, or None without so many."""
    group = _group_of_rank(counts, ["digits"], k) if k > 0 else None
    if group is None:
        return None
    k -= group["before"]
    inside = rows.where(F.substring(KEY, 1, DIGITS) == group["digits"])
    tasks = inside.groupBy(KEY, F.shiftright("_row", WITHIN).alias("task")).agg(F.count(F.lit(1)).alias("n"))
    held = _group_of_rank(tasks, [KEY, "task"], k)
    own = rows.where((F.col(KEY) == held[KEY]) & (F.shiftright("_row", WITHIN) == held["task"]))
    row = own.select("_row").orderBy("_row").offset(k - held["before"] - 1).limit(1).first()
    return held[KEY], row["_row"]


def _up_to(cut: tuple[str, int] | None) -> Column:
    if cut is None:
        return F.lit(False)
    key, row = cut
    return (F.col(KEY) < key) | ((F.col(KEY) == key) & (F.col("_row") <= row))


def sample_n(df: DataFrame, n: int, key_cols=("contig", "position"),
             seed: int = SHUFFLE_SEED) -> DataFrame:
    """Exactly n rows chosen by the seeded order (all rows if n is larger)."""
    rows = _numbered(df, key_cols, seed)
    counts = stored(first_counts(rows), "key-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return (rows if n >= total else rows.where(_up_to(kth_row(rows, n, counts)))).drop("_row")


def exact_split(df: DataFrame, frac: float = 0.2, key_cols=("contig", "position"),
                seed: int = SHUFFLE_SEED) -> DataFrame:
    """Adds ``split``: exactly round(frac * n) rows 'valid', the rest 'train'.

    The result reads the stored rows: what is computed on it does not compute ``df`` again.
    """
    rows = _numbered(df, key_cols, seed)
    counts = stored(first_counts(rows), "key-counts")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cut = kth_row(rows, int(round(frac * total)), counts)
    return rows.withColumn("split", F.when(_up_to(cut), F.lit("valid")).otherwise(F.lit("train"))).drop("_row")
