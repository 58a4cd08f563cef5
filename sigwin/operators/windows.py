"""Seven-position context windows over the site table.

A window is a centre position with all positions centre-3 .. centre+3 present
in the same contig.  Every window becomes one wide row with 8 features per
offset, named ``-3_x`` ... ``0_x`` ... ``+3_x`` (56 features).

Skew: a window over ``partitionBy(contig)`` would put a whole transcript (or
chromosome) into one task.  Positions are therefore cut into buckets of
``bucket`` positions; a row within ``radius`` of a bucket edge is copied into
the neighbouring bucket (at most ``2*radius`` copies per bucket), the window
runs over ``(contig, bucket)``, and each centre is emitted only by its home
bucket.  All lag/lead calls share one window spec, so the plan has one
Exchange, one Sort and one Window node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigwin import schemas as S
from sigwin.functions.columns import all_finite, is_drach
from sigwin.operators.counts import RowCounts, watch

DEFAULT_BUCKET = 4096
MOTIF_OFFSET = -2          # the 5-mer starting at centre-2 has the centre in its middle
MOTIF_COL = "motif_kmer"
BUCKET_COL = "position_bucket"   # of a staged site table


def _bucket_spec(radius: int, bucket: int):
    if bucket <= 2 * radius:
        raise ValueError("bucket must exceed twice the radius")
    p = F.col("position")
    lo = F.floor((p - radius) / F.lit(bucket))
    hi = F.floor((p + radius) / F.lit(bucket))
    return F.explode(F.array_distinct(F.array(lo, hi))), F.floor(p / F.lit(bucket))


def staged_sites(sites: DataFrame, radius: int = S.RADIUS, bucket: int = DEFAULT_BUCKET) -> DataFrame:
    """``sites`` with ``BUCKET_COL``: a row for each bucket a site is needed in."""
    explode_b, _ = _bucket_spec(radius, bucket)
    return (sites.where(F.col("contig").isNotNull() & F.col("position").isNotNull())
            .withColumn(BUCKET_COL, explode_b))


def context_windows(sites: DataFrame, radius: int = S.RADIUS,
                    features: list[str] | None = None, bucket: int = DEFAULT_BUCKET,
                    with_motif_kmer: bool = True) -> DataFrame:
    """Wide windows: contig, position (centre), features per offset, and the
    k-mer at offset -2 (``motif_kmer``) for the motif filter.  A staged table
    (``staged_sites`` with the same radius and bucket, as ``sources.clustered``
    stores it) is taken as it is."""
    features = S.SITE_FEATURES if features is None else features
    _, home = _bucket_spec(radius, bucket)
    cols = ["contig", "position"] + features + (["reference_kmer"] if with_motif_kmer else [])
    staged = sites if BUCKET_COL in sites.columns else staged_sites(sites.select(*cols), radius, bucket)
    staged = staged.select(*cols, F.col(BUCKET_COL).alias("_b"))
    w = Window.partitionBy("contig", "_b").orderBy("position")
    p = F.col("position")
    out = [F.col("contig"), p]
    for o in range(-radius, radius + 1):
        for c in features:
            if o < 0:
                e = F.lag(c, -o).over(w)
            elif o > 0:
                e = F.lead(c, o).over(w)
            else:
                e = F.col(c)
            out.append(e.alias(S.feature_name(o, c)))
    if with_motif_kmer:
        out.append(F.lag("reference_kmer", -MOTIF_OFFSET).over(w).alias(MOTIF_COL))
    complete = ((F.lag("position", radius).over(w) == p - radius)
                & (F.lead("position", radius).over(w) == p + radius))
    return (staged.select(*out, complete.alias("_complete"), (home == F.col("_b")).alias("_home"))
            .where(F.col("_complete") & F.col("_home"))
            .drop("_complete", "_home"))


def context_centres(sites: DataFrame, radius: int = S.RADIUS,
                    bucket: int = DEFAULT_BUCKET) -> DataFrame:
    """(contig, position) of every complete window centre."""
    return context_windows(sites, radius, features=[], bucket=bucket,
                           with_motif_kmer=False).select("contig", "position")


def drop_kmer_columns(windows: DataFrame) -> DataFrame:
    """Remove every column whose name contains 'reference_kmer' or the
    helper motif column."""
    return windows.drop(*[c for c in windows.columns if "reference_kmer" in c or c == MOTIF_COL])


def windows_wide(sites: DataFrame, radius: int = S.RADIUS, bucket: int = DEFAULT_BUCKET) -> DataFrame:
    return drop_kmer_columns(context_windows(sites, radius, bucket=bucket))


def motif_filter(windows: DataFrame) -> DataFrame:
    """Keep windows whose k-mer at offset -2 is an exact DRACH 5-mer."""
    return windows.where(is_drach(F.col(MOTIF_COL)))


def finite_filter(windows: DataFrame, features: list[str] | None = None, rows: RowCounts | None = None) -> DataFrame:
    """Drop windows with a NULL, NaN or +/-inf feature; counted as ``not_finite`` in ``rows``."""
    features = features or [c for c in windows.columns if c in set(S.FEATURES)]
    return watch(windows, rows, not_finite=~all_finite(features)).where(all_finite(features))


def windows_long(sites: DataFrame, radius: int = S.RADIUS, bucket: int = DEFAULT_BUCKET,
                 features: list[str] | None = None) -> DataFrame:
    """Seven rows per window: (contig, position = centre, offset,
    site_position, <features>) -- the wide row unpivoted, no extra shuffle."""
    features = features or S.SITE_FEATURES
    wide = context_windows(sites, radius, features, bucket, with_motif_kmer=False)
    rows = F.array(*[
        F.struct(F.lit(o).alias("offset"), (F.col("position") + o).alias("site_position"),
                 *[F.col(S.q(S.feature_name(o, c))).alias(c) for c in features])
        for o in range(-radius, radius + 1)])
    return wide.select("contig", "position", F.inline(rows))
