"""Ragged reactivity profiles, read field by field.

A line ``tx  length  *  s0  s1 ...`` can be as long as a chromosome, so no line is ever
a row.  The file is read with the tab as the separator of records: a row is one field,
and the line breaks are found inside fields (``0.87<newline>ENST2.1`` ends one line and
begins the next).  Fields are numbered by offsets of blocks of rows, and each knows the
last break before it; from there its place in its line follows.

Rules, as for whole lines: white space at both ends of a line is stripped and empty
lines are skipped; the first line of at least four fields gives a transcript's scores;
any shorter line of the transcript, before or after, leaves it without any.  They need
the beginning and the end of each line only.  No row, aggregate buffer or window holds
a transcript: windows are over at most ``BLOCK`` fields.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sigwin.operators.joins import broadcast_if_small
from sigwin.session import stored

#: Rows of a block, within one split of a file.
BLOCK = 1 << 16
BREAK = "\r\n|\n|\r"
SPLIT = ["file", "start", "block"]


def read_profile_fields(spark: SparkSession, path: str) -> DataFrame:
    """``(value, file, start, row)``: the fields of a file or folder; ``row`` rises within a split (file, start)."""
    return spark.read.option("lineSep", "\t").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"))


def _stripped(text: Column, left: Column, right: Column) -> Column:
    text = F.when(left, F.regexp_replace(text, r"^\s+", "")).otherwise(text)
    return F.when(right, F.regexp_replace(text, r"\s+$", "")).otherwise(text)


def numbered_fields(fields: DataFrame) -> DataFrame:
    """``(file, parts, n, line)``: the parts of a field between line breaks, its number in its file, and
    the line of its first part: the field and part that begin it ((-1, 0) for a file's first line)."""
    rows = stored(fields.select("file", "start", "row", F.floor(F.col("row") / F.lit(BLOCK)).alias("block"),
                                F.split("value", BREAK, -1).alias("parts")), "profile-fields")
    broken = F.size("parts") > 1
    blocks = rows.groupBy(*SPLIT).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"),
                                      F.max(F.when(broken, F.struct("row", (F.size("parts") - 1).alias("part"))))
                                      .alias("last"))
    # One row for each block of a file.
    earlier = Window.partitionBy("file").orderBy("start", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0)))
    blocks = blocks.withColumn("last", F.when(F.col("last").isNotNull(), F.struct(
        (F.col("before") + F.col("last.row") - F.col("first")).alias("n"), F.col("last.part").alias("part"))))
    blocks = blocks.withColumn("carried", F.last("last", ignorenulls=True).over(earlier))
    side = broadcast_if_small(blocks.select(*SPLIT, "first", "before", "carried"), name="profile-blocks")
    placed = rows.join(side, SPLIT).withColumn("n", F.col("before") + F.col("row") - F.col("first"))
    within = Window.partitionBy(*SPLIT).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    head = F.when(broken, F.struct(F.col("n").cast("long").alias("n"), (F.size("parts") - 1).alias("part")))
    start = F.struct(F.lit(-1).cast("long").alias("n"), F.lit(0).alias("part"))
    line = F.coalesce(F.last(head, ignorenulls=True).over(within), F.col("carried"), start)
    return placed.select("file", "parts", "n", line.alias("line"))


def line_fields(fields: DataFrame) -> DataFrame:
    """``(file, line, at, text)``: every field of every line and its place there."""
    numbered = numbered_fields(fields)
    parts = numbered.select("file", "n", "line", F.posexplode("parts").alias("part", "text"))
    own = F.struct(F.col("n"), F.col("part"))
    first = F.col("part") == 0
    return parts.select(
        "file", F.when(first, F.col("line")).otherwise(own).alias("line"),
        F.when(first, F.col("n") - F.greatest(F.col("line.n"), F.lit(0))).otherwise(0).alias("at"), "text")


def line_heads(cells: DataFrame) -> DataFrame:
    """``(file, line, tx, first, last)`` of every line that is not empty: its first field's text, and the
    places of its first and last fields."""
    filled = cells.where(F.col("text").rlike(r"\S"))
    heads = filled.groupBy("file", "line").agg(F.min("at").alias("first"), F.max("at").alias("last"),
                                               F.min_by("text", "at").alias("tx"))
    return heads.withColumn("tx", _stripped(F.col("tx"), F.lit(True), F.col("first") == F.col("last")))


def winning_lines(heads: DataFrame) -> DataFrame:
    """``(tx, file, line, first, last)``: the line that gives each transcript's scores."""
    long = F.col("last") - F.col("first") >= 3
    ends = F.struct("file", "line", "first", "last")
    return (heads.groupBy("tx").agg(F.max((~long).cast("int")).alias("short"), F.min(F.when(long, ends)).alias("w"))
            .where("short = 0").select("tx", "w.*"))


def profile_scores(fields: DataFrame) -> DataFrame:
    """``(tx, pos, score)``: the scores, as text, of every transcript that has them, by zero-based position."""
    cells = stored(line_fields(fields), "profile-cells")
    winners = broadcast_if_small(winning_lines(line_heads(cells)), name="profile-lines")
    pos = F.col("at") - F.col("first") - 3
    scores = cells.join(winners, ["file", "line"]).where((pos >= 0) & (F.col("at") <= F.col("last")))
    return scores.select("tx", pos.cast("long").alias("pos"),
                         _stripped(F.col("text"), F.lit(False), F.col("at") == F.col("last")).alias("score"))


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """Reactivity profile (A4) of a file or folder as ``(tx, pos, score)``."""
    return profile_scores(read_profile_fields(spark, path))
