"""Fixed column layouts of the data model (events, sites, windows, predictions)."""

from __future__ import annotations

from pyspark.sql import types as T

KEYS = ["contig", "position"]

# Required event columns, optional columns dropped on read,
# and the site-table layout written by the cleaning stage, in this order.
EVENT_REQUIRED = [
    "contig", "position", "reference_kmer", "event_level_mean", "event_stdv",
    "event_length", "model_stdv", "standardized_level",
]
EVENT_DROPPED = ["strand", "model_kmer", "model_mean"]
SITE_COLUMNS = [
    "contig", "position", "reference_kmer", "event_level_mean", "event_stdv",
    "event_length", "standardized_level", "event_level_median",
    "event_stdv_median", "event_length_median", "diff_stdv",
]

# Columns averaged with 3-sigma clipping, and columns given a plain median.
CLIPPED_COLUMNS = ["event_level_mean", "event_stdv", "event_length", "standardized_level"]
MEDIAN_COLUMNS = {
    "event_level_median": "event_level_mean",
    "event_stdv_median": "event_stdv",
    "event_length_median": "event_length",
}

# The eight numeric site columns that every window offset carries.
SITE_FEATURES = [c for c in SITE_COLUMNS[3:]]
RADIUS = 3
OFFSETS = list(range(-RADIUS, RADIUS + 1))

PREDICTION_COLUMNS = [
    "contig", "position", "NeuralNetwork_Prob", "RandomForest_Prob", "Combined_Prob",
]


def offset_prefix(offset: int) -> str:
    """'-3', '-2', '-1', '0', '+1', '+2', '+3'."""
    return f"+{offset}" if offset > 0 else str(offset)


def feature_name(offset: int, column: str) -> str:
    return f"{offset_prefix(offset)}_{column}"


def feature_names(columns: list[str] | None = None, radius: int = RADIUS) -> list[str]:
    columns = columns or SITE_FEATURES
    return [feature_name(o, c) for o in range(-radius, radius + 1) for c in columns]


FEATURES = feature_names()
WINDOW_COLUMNS = KEYS + FEATURES + ["label"]

EVENT_SCHEMA = T.StructType(
    [T.StructField("contig", T.StringType()), T.StructField("position", T.LongType()),
     T.StructField("reference_kmer", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in EVENT_REQUIRED[3:]]
    + [T.StructField("ord", T.LongType())]
)

SITE_SCHEMA = T.StructType(
    [T.StructField("contig", T.StringType()), T.StructField("position", T.LongType()),
     T.StructField("reference_kmer", T.StringType())]
    + [T.StructField(c, T.DoubleType()) for c in SITE_COLUMNS[3:]]
)

WINDOW_SCHEMA = T.StructType(
    [T.StructField("contig", T.StringType()), T.StructField("position", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in FEATURES]
    + [T.StructField("label", T.IntegerType())]
)

PREDICTION_SCHEMA = T.StructType(
    [T.StructField("contig", T.StringType()), T.StructField("position", T.LongType())]
    + [T.StructField(c, T.DoubleType()) for c in PREDICTION_COLUMNS[2:]]
)


def q(name: str) -> str:
    """Back-quote a column name for Spark SQL strings (names such as '+1_x')."""
    return "`" + name.replace("`", "``") + "`"
