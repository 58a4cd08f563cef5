"""Scalar column expressions (all JVM-side built-ins, no Python UDF)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Transcript id prefix used as the join key, and the DRACH
# motif (D = A/G/T, R = A/G, A, C, H = A/C/T; T stands for U).
TRANSCRIPT_ID_PATTERN = r"^ENST\d+\.\d+"
DRACH_PATTERN = "^[AGT][AG]AC[ACT]$"
SHUFFLE_SEED = 42


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contig_key(contig="contig") -> Column:
    """Transcript id prefix of a contig, NULL when the contig has none."""
    return F.nullif(F.regexp_extract(_col(contig), TRANSCRIPT_ID_PATTERN, 0), F.lit(""))


def is_drach(kmer) -> Column:
    """Exact five-letter DRACH test.  The length test matters: Java's '$'
    also matches before a trailing newline."""
    k = _col(kmer)
    return F.coalesce((F.length(k) == 5) & k.rlike(DRACH_PATTERN), F.lit(False))


def coerce_numeric(c) -> Column:
    """Text to double; unparseable text becomes NULL (pandas' errors='coerce')."""
    return F.expr(f"try_cast({c} AS DOUBLE)") if isinstance(c, str) else c.try_cast(T.DoubleType())


def nan_to_null(c) -> Column:
    x = _col(c)
    return F.when(~F.isnan(x), x)


def is_finite(c) -> Column:
    x = _col(c)
    return F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))


def all_finite(columns) -> Column:
    """True when every column is non-NULL, not NaN and not +/-inf."""
    return reduce(lambda a, b: a & b, [is_finite(c) for c in columns])


def binarise(score, lo: float = 0.2, hi: float = 0.8) -> Column:
    """Reactivity cut: <= lo -> 0, >= hi -> 1, otherwise (and NaN/NULL) NULL."""
    s = _col(score)
    return (F.when(F.isnan(s), F.lit(None))
            .when(s <= lo, F.lit(0))
            .when(s >= hi, F.lit(1))
            .cast("int"))


def softmax2(z0, z1) -> Column:
    """Probability of class 1 from two logits."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-(_col(z1) - _col(z0))))


def predicted_class(z0, z1) -> Column:
    """Class of the larger logit; a tie is class 0."""
    return F.when(_col(z1) > _col(z0), 1).otherwise(0)


def ensemble_mean(a, b) -> Column:
    return (_col(a) + _col(b)) / F.lit(2.0)


def focal_loss_terms(label, z0, z1, alpha: float = 1.0, gamma: float = 2.0) -> Column:
    """Per-row focal loss from two logits: alpha * (1 - p_t)^gamma * ce,
    ce = logsumexp(z0, z1) - z_true (stable), p_t = exp(-ce)."""
    a, b = _col(z0), _col(z1)
    m = F.greatest(a, b)
    lse = m + F.log(F.exp(a - m) + F.exp(b - m))
    z_true = F.when(_col(label) == 1, b).otherwise(a)
    ce = lse - z_true
    pt = F.exp(-ce)
    return F.lit(float(alpha)) * F.pow(F.lit(1.0) - pt, F.lit(float(gamma))) * ce


def bit_is_set(bits: Column, at: Column) -> Column:
    """Whether bit ``at`` of a bitmap (``bitmap_construct_agg``) is set; NULL without a bitmap."""
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (at % 8).cast("int")) == 1


def shuffle_key(*cols, seed: int = SHUFFLE_SEED) -> Column:
    """Reproducible permutation key: md5 of the row key and the seed.  Equal in
    Spark and DuckDB, and independent of partitioning (unlike rand(seed))."""
    parts = [_col(c).cast("string") for c in cols] + [F.lit(str(seed))]
    return F.md5(F.concat_ws("|", *parts))


def round_half_up(c, digits: int = 6) -> Column:
    """Round through decimal(38,12), half up.  Unlike round(double), which
    works on Java's decimal rendering of the double, this gives the same
    result in Spark and DuckDB.  Non-finite or huge values pass unchanged."""
    x = _col(c)
    return F.coalesce(F.round(x.try_cast("decimal(38,12)"), digits).cast("double"), x)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (used where results are compared)."""
    return df.select([
        round_half_up(F.col(S_q(f.name)), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(S_q(f.name))
        for f in df.schema.fields
    ])


def S_q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
