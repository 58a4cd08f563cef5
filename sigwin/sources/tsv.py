"""Readers for the tab-separated files of the pipeline (events, sites, site
reference, windows); ``sources.profile`` reads reactivity profiles.

Every column is read as text and converted with ``try_cast`` so that the
tokens ``nan``, ``inf`` and ``-inf`` survive (the typed CSV reader turns them
into NULL) and unparseable text becomes NULL instead of failing the job.
NaN becomes NULL at this boundary; +/-inf is kept until the finite filter.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigwin import schemas as S
from sigwin.functions.columns import nan_to_null


class SchemaError(ValueError):
    """Raised when an input misses required columns."""


def _read_text_table(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("sep", "\t").option("header", True)
            .option("inferSchema", False).option("nullValue", None)
            .csv(path))


def _double(name: str) -> Column:
    return nan_to_null(F.col(name).try_cast(T.DoubleType())).alias(name)


def _long(name: str) -> Column:
    return _integer(F.col(name), T.LongType()).alias(name)


def _file_order() -> Column:
    """The place of a row in a read of many files: file, split, row of the split.
    Ids alone follow how splits are packed into tasks."""
    return F.struct("_metadata.file_path", "_metadata.file_block_start",
                    F.monotonically_increasing_id().alias("row"))


def events_from_frame(df: DataFrame, ord_col: str | None = None,
                      order: Column | None = None) -> DataFrame:
    """Bring an event frame (any column types) to the event schema.

    Optional columns strand / model_kmer / model_mean are dropped, the eight
    required columns are checked, and ``ord`` (input order, needed for the
    first-row rule) is taken from ``ord_col``, else from a column ``ord``, else
    from ``order`` (any orderable expression), else from the frame's own order.
    """
    df = df.drop(*S.EVENT_DROPPED)
    missing = [c for c in S.EVENT_REQUIRED if c not in df.columns]
    if missing:
        raise SchemaError(f"the table has no column {', '.join(missing)}")
    if ord_col is not None:
        ord_expr = F.col(ord_col).cast("long")
    elif "ord" in df.columns:
        ord_expr = F.col("ord").cast("long")
    else:
        ord_expr = order if order is not None else F.monotonically_increasing_id()
    return df.select(
        F.col("contig").cast("string").alias("contig"),
        _long("position"),
        F.col("reference_kmer").cast("string").alias("reference_kmer"),
        *[_double(c) for c in S.EVENT_REQUIRED[3:]],
        ord_expr.alias("ord"),
    )


def read_events(spark: SparkSession, path: str, ord_col: str | None = None) -> DataFrame:
    """Event table from a TSV with header (A1)."""
    return events_from_frame(_read_text_table(spark, path), ord_col, _file_order())


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """Site table (the cleaning output) from TSV (A2)."""
    df = _read_text_table(spark, path)
    missing = [c for c in S.SITE_COLUMNS if c not in df.columns]
    if missing:
        raise SchemaError(f"the table has no column {', '.join(missing)}")
    return df.select(F.col("contig"), _long("position"), F.col("reference_kmer"),
                     *[_double(c) for c in S.SITE_COLUMNS[3:]])


def read_site_reference(spark: SparkSession, path: str) -> DataFrame:
    """Known sites (A3): header line, then transcript id and 1-based position.
    Columns are taken by place, as the header names vary."""
    df = _read_text_table(spark, path)
    c0, c1 = df.columns[0], df.columns[1]
    return (df.select(F.col(c0).alias("tx"), F.col(c1).try_cast(T.LongType()).alias("pos1"))
            .where(F.col("tx").isNotNull() & F.col("pos1").isNotNull())
            .dropDuplicates(["tx", "pos1"]))


def parse_profile_lines(lines: DataFrame) -> DataFrame:
    """Ragged profile lines ``(value, ord)``, one a row, as ``(tx, scores)``, by the rules of ``sources.profile``:
    the first line of at least four fields gives the scores, any shorter one leaves the transcript without.

    For lines that fit a row; ``sources.profile`` reads files of any."""
    stripped = F.regexp_replace("value", r"^\s+|\s+$", "")
    fields = (lines.select(stripped.alias("line"), "ord").where(F.length("line") > 0)
              .select(F.split("line", "\t", -1).alias("cols"), "ord"))
    long = F.size("cols") >= 4
    scores = F.slice("cols", F.lit(4), F.greatest(F.size("cols") - 3, F.lit(0)))
    per_line = fields.select(F.col("cols")[0].alias("tx"), (~long).alias("short"),
                             F.when(long, scores).alias("scores"), F.when(long, F.col("ord")).alias("long_ord"))
    none = F.array().cast("array<string>")
    return per_line.groupBy("tx").agg(F.when(F.max("short"), none).otherwise(F.min_by("scores", "long_ord")).alias("scores"))


def profile_to_long(profile: DataFrame) -> DataFrame:
    """``(tx, scores)`` as ``(tx, pos, score)``: the zero-based position of every score."""
    return profile.select("tx", F.posexplode("scores").alias("pos", "score")).select(
        "tx", F.col("pos").cast("long").alias("pos"), "score")


def _integer(text: Column, kind: T.DataType) -> Column:
    """A whole number that fits, also written with a fraction of zero (``1.0``); else NULL."""
    number = text.try_cast(T.DoubleType())
    whole = F.when((F.rint(number) == number) & (F.abs(number) < 2.0 ** 53), number.try_cast(kind))
    return F.coalesce(text.try_cast(kind), whole)


def read_windows(spark: SparkSession, path: str, with_accounting: bool = False):
    """Window table (A5) from tab-separated text.

    Lines with more fields than the header are skipped (pandas'
    on_bad_lines='skip'); shorter lines are padded with NULL and later
    removed by the finite filter.  Lines whose position or label is no whole
    number (``nan``, ``inf``, ``5.7``, text) are dropped; a label may be
    missing.  With ``with_accounting`` also returns an ``Observation`` with the
    lines read, skipped and dropped, counted by the first job that reads the windows.
    """
    lines = spark.read.text(path)
    header = lines.first()
    if header is None:
        raise SchemaError(f"empty window file: {path}")
    names = header[0].rstrip("\r\n").split("\t")
    parts = (lines.where(F.col("value") != F.lit(header[0]))
             .select(F.split(F.regexp_replace("value", "\r$", ""), "\t", -1).alias("p")))
    fits = F.size("p") <= len(names)
    whole = {n: _integer(F.get(F.col("p"), names.index(n)), kind)
             for n, kind in (("position", T.LongType()), ("label", T.IntegerType())) if n in names}
    usable = F.lit(True)
    for name, value in whole.items():
        given = F.get(F.col("p"), names.index(name))
        missing = (F.lit(name == "label") & (given.isNull() | (F.trim(given) == "")))
        usable = usable & F.coalesce(value.isNotNull() | missing, F.lit(False))
    seen = None
    if with_accounting:
        seen = Observation(f"windows-{uuid.uuid4().hex}")
        parts = parts.observe(seen, F.count(F.lit(1)).alias("lines_read"),
                              F.count(F.when(~fits, 1)).alias("lines_skipped"),
                              F.count(F.when(fits & ~usable, 1)).alias("lines_dropped"))
    cols = []
    for i, name in enumerate(names):
        raw = F.get(F.col("p"), i)
        if name == "contig":
            cols.append(raw.alias(name))
        elif name in whole:
            cols.append(whole[name].alias(name))
        else:
            cols.append(nan_to_null(raw.try_cast(T.DoubleType())).alias(name))
    out = parts.where(fits & usable).select(*cols)
    return (out, seen) if with_accounting else out


def check_window_columns(df: DataFrame, expected: int = len(S.WINDOW_COLUMNS)) -> None:
    """The 59-column gate of the training input."""
    if len(df.columns) != expected:
        raise SchemaError(
            f"Expected {expected} columns (contig+position+56 features+label), "
            f"found {len(df.columns)}")
