"""Cleaning: collapse all events at a (contig, position) into one site row.

Per site and column:

* clipped mean (3 sigma around the median, bound inclusive, population
  std).  One row: the value.  A NULL among several rows: NULL.  Std NaN
  (an inf in the group) or 0: the median.
* median with NULLs skipped (three columns)
* modal k-mer, smallest of tied values
* ``model_stdv`` of the first event in input order (``ord``), even if NULL
* ``diff_stdv = (clipped event_stdv - model_stdv) / model_stdv`` (NULL on a
  zero divisor)

Plan: four scans of the events, and up to three of the rows of large sites.

    1. events -> partial agg -> Exchange -> final agg (counts, std, mode, first)
    2. events -> counts -> Exchange -> the large sites            (operators.medians)
    3. events -> partial agg -> Exchange -> medians of the other sites
       rows of large sites -> digit counts -> Exchange -> middle digits, up to three times
    4. events -> join(median, std) -> partial agg -> Exchange -> final agg (clipped means)

All aggregates are combined map side.  The joins broadcast the per-site table if its
bytes allow (``sigwin.broadcast.maxBytes``); beyond that they are shuffle joins whose
per-site side has one row a site, so that AQE can split the events of a site that holds
a third of all.  The medians of large sites come from counts of digits: no buffer holds
more than ``medians.DIRECT`` values of a site, however many it has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigwin import schemas as S
from sigwin.operators.joins import broadcast_if_small
from sigwin.operators.medians import exact_medians

K = S.KEYS
CLIP_SIGMA = 3.0


def _keyed(events: DataFrame) -> DataFrame:
    """Rows with a key (NULL keys are dropped), NaN values as NULL (missing)."""
    values = [c for c in (*S.CLIPPED_COLUMNS, "model_stdv") if c in events.columns]
    events = events.withColumns({c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in values})
    return events.where(F.col("contig").isNotNull() & F.col("position").isNotNull())


def _med(c: str) -> str:
    return f"_med_{c}"


def _sd(c: str) -> str:
    return f"_sd_{c}"


def _nn(c: str) -> str:
    return f"_nn_{c}"


def site_statistics(events: DataFrame, columns=S.CLIPPED_COLUMNS,
                    with_kmer: bool = True, with_model: bool = True) -> DataFrame:
    """One row per site: row count, and per column non-NULL count, median
    and population std; optionally the modal k-mer and first model_stdv."""
    keyed = _keyed(events)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in columns:
        aggs += [F.count(c).alias(_nn(c)), F.stddev_pop(c).alias(_sd(c))]
    if with_kmer:
        aggs.append(F.mode("reference_kmer", True).alias("reference_kmer"))
    if with_model:
        aggs.append(F.min_by("model_stdv", "ord").alias("model_stdv"))
    stats = keyed.groupBy(*K).agg(*aggs)
    medians = exact_medians(keyed, K, list(columns), [_med(c) for c in columns])
    return stats.join(medians, K, "left")


def _clip_result(c: str):
    """Final clipped value from the statistics and the clipped sums."""
    med, sd = F.col(_med(c)), F.col(_sd(c))
    return (F.when(F.col("_n") == 1, med)
            .when(F.col(_nn(c)) < F.col("_n"), F.lit(None).cast("double"))
            .when(sd.isNull() | F.isnan(sd) | (sd == 0), med)
            .when(F.col(f"_mean_{c}").isNotNull(), F.col(f"_mean_{c}"))
            .otherwise(med))


def with_clipped_means(events: DataFrame, stats: DataFrame, columns=S.CLIPPED_COLUMNS,
                       sigma: float = CLIP_SIGMA, max_broadcast_bytes: int | None = None) -> DataFrame:
    """Join the statistics back to the events, sum the values inside the
    clip band per site, and add the clipped mean of every column to
    ``stats`` (as the column's own name)."""
    stats = broadcast_if_small(stats, max_broadcast_bytes, "site-statistics")
    band_cols = K + [x for c in columns for x in (_med(c), _sd(c))]
    joined = _keyed(events).select(*K, *columns).join(stats.select(*band_cols), K)
    sums = []
    for c in columns:
        inside = F.abs(F.col(c) - F.col(_med(c))) <= F.lit(sigma) * F.col(_sd(c))
        sums.append(F.avg(F.when(inside, F.col(c))).alias(f"_mean_{c}"))
    out = stats.join(joined.groupBy(*K).agg(*sums), K, "left")
    return out.select(*[F.col(x) for x in stats.columns],
                      *[_clip_result(c).alias(c) for c in columns])


def clipped_mean(events: DataFrame, columns=S.CLIPPED_COLUMNS, sigma: float = CLIP_SIGMA) -> DataFrame:
    """(contig, position, <clipped mean per column>)."""
    stats = site_statistics(events, columns, with_kmer=False, with_model=False)
    return with_clipped_means(events, stats, columns, sigma).select(*K, *columns)


def group_median(events: DataFrame) -> DataFrame:
    """(contig, position, event_level_median, event_stdv_median, event_length_median)."""
    keyed = _keyed(events)
    sources, names = list(S.MEDIAN_COLUMNS.values()), list(S.MEDIAN_COLUMNS)
    # Sites without any value have a row too.
    return keyed.select(*K).distinct().join(exact_medians(keyed, K, sources, names), K, "left").select(*K, *names)


def kmer_mode(events: DataFrame) -> DataFrame:
    """Modal k-mer per site; the smallest wins a tie, NULLs are ignored."""
    return _keyed(events).groupBy(*K).agg(F.mode("reference_kmer", True).alias("reference_kmer"))


def first_model_stdv(events: DataFrame) -> DataFrame:
    """model_stdv of the first event of the site in input order."""
    return _keyed(events).groupBy(*K).agg(F.min_by("model_stdv", "ord").alias("model_stdv"))


def relative_diff(a, b):
    """(a - b) / b; NULL when b is 0 (ANSI-safe)."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.col(b) if isinstance(b, str) else b
    return F.try_divide(a - b, b)


def clean_events(events: DataFrame, sigma: float = CLIP_SIGMA,
                 max_broadcast_bytes: int | None = None) -> DataFrame:
    """Event table -> site table (11 columns), unordered (sort at the sink)."""
    full = with_clipped_means(events, site_statistics(events), S.CLIPPED_COLUMNS, sigma, max_broadcast_bytes)
    medians = [F.col(_med(src)).alias(dst) for dst, src in S.MEDIAN_COLUMNS.items()]
    return full.select(
        *K, "reference_kmer", *S.CLIPPED_COLUMNS, *medians,
        relative_diff("event_stdv", "model_stdv").alias("diff_stdv"))


def clean_events_with_model(events: DataFrame) -> DataFrame:
    """Like clean_events but keeps model_stdv (for the relative-diff check)."""
    full = with_clipped_means(events, site_statistics(events))
    return full.select(*K, "event_stdv", "model_stdv",
                       relative_diff("event_stdv", "model_stdv").alias("diff_stdv"))
