"""Writers (B1-B5).  Output is clustered by (contig, position) through a
range partition + sort within partitions: a distributed sort, no single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, order_by: list | None = None,
              mode: str = "overwrite") -> None:
    if order_by:
        df = df.orderBy(*order_by)
    (df.write.mode(mode).option("sep", "\t").option("header", True)
     .option("emptyValue", "").csv(path))


def write_parquet(df: DataFrame, path: str, order_by: list | None = None,
                  mode: str = "overwrite") -> None:
    if order_by:
        df = df.orderBy(*order_by)
    df.write.mode(mode).parquet(path)


def write_sites(df: DataFrame, path: str, fmt: str = "tsv") -> None:
    """Site table (B1), ordered by contig, position."""
    (write_tsv if fmt == "tsv" else write_parquet)(df, path, ["contig", "position"])


def write_training_windows(df: DataFrame, path: str, fmt: str = "tsv",
                           shuffle_col: str | None = None) -> None:
    """Labelled windows (B2); m6A sets are written in seeded-shuffle order."""
    order = [shuffle_col] if shuffle_col else ["contig", "position"]
    cols = [c for c in df.columns if c != shuffle_col]
    if shuffle_col:
        df = df.orderBy(shuffle_col).select(*cols)
        order = None
    (write_tsv if fmt == "tsv" else write_parquet)(df, path, order)


def write_inference_sets(tagged: DataFrame, prefix: str, fmt: str = "tsv") -> dict[str, str]:
    """Both inference outputs (B3) by one job: the folder ``prefix`` has a partition ``set=...``
    for each set of the tagged windows, ordered by contig, position.  Returns set -> path."""
    writer = tagged.orderBy("set", "contig", "position").write.mode("overwrite").partitionBy("set")
    if fmt == "tsv":
        writer.option("sep", "\t").option("header", True).option("emptyValue", "").csv(prefix)
    else:
        writer.parquet(prefix)
    return {name: f"{prefix}/set={name}" for name in ("structure", "m6a")}


def write_predictions(df: DataFrame, path: str, fmt: str = "tsv") -> None:
    """Prediction table (B4), ordered by contig, position."""
    (write_tsv if fmt == "tsv" else write_parquet)(df, path, [F.col("contig"), F.col("position")])
