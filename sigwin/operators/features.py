"""Class weights, standardisation and row accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sigwin import schemas as S


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weights n / (n_classes * n_c): (label, n, weight).
    The window runs over the per-class table (one row per class)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    everything = Window.partitionBy()
    total = F.sum("n").over(everything)
    classes = F.count(F.lit(1)).over(everything)
    return counts.select(label, "n", (total / (classes * F.col("n"))).alias("weight"))


def with_class_weight(df: DataFrame, label: str = "label", weight_col: str = "weight") -> DataFrame:
    """Attach the balanced weight of each row's class (the per-class table has
    one row per class, so broadcasting it is bounded)."""
    w = class_weights(df, label).select(label, F.col("weight").alias(weight_col))
    return df.join(F.broadcast(w), label)


def scaler_stats(df: DataFrame, features: list[str] | None = None) -> DataFrame:
    """Per feature: mean, population std, and scale (std, or 1 when std is 0).
    One aggregate of 2 x features columns (partial on the map side), then
    unpivoted to (feature, mean, std, scale)."""
    features = features or S.FEATURES
    aggs = []
    for i, c in enumerate(features):
        aggs += [F.avg(F.col(S.q(c))).alias(f"m{i}"), F.stddev_pop(F.col(S.q(c))).alias(f"s{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("idx"),
                              F.col(f"m{i}").alias("mean"), F.col(f"s{i}").alias("std"))
                     for i, c in enumerate(features)])
    return (wide.select(F.inline(rows))
            .withColumn("scale", F.when(F.col("std") == 0, F.lit(1.0)).otherwise(F.col("std"))))


def fit_scaler(df: DataFrame, features: list[str] | None = None) -> dict[str, tuple[float, float]]:
    """Fitted scaler as small driver-side state: {feature: (mean, scale)}."""
    features = features or S.FEATURES
    rows = scaler_stats(df, features).collect()
    if any(r["mean"] is None for r in rows):
        raise ValueError("no finite training row is left to fit on")
    return {r["feature"]: (float(r["mean"]), float(r["scale"])) for r in rows}


def scale_features(df: DataFrame, scaler: dict[str, tuple[float, float]],
                   keep: list[str] | None = None) -> DataFrame:
    """(x - mean) / scale for every fitted feature, as column expressions."""
    keep = keep if keep is not None else [c for c in df.columns if c not in scaler]
    return df.select(*[F.col(S.q(c)) for c in keep],
                     *[((F.col(S.q(c)) - F.lit(m)) / F.lit(s)).alias(c)
                       for c, (m, s) in scaler.items()])


def scale_with_stats(df: DataFrame, stats: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Scaling from a stats frame (feature, mean, scale); the frame has one
    row per feature, so it is collected as fitted state."""
    scaler = {r["feature"]: (float(r["mean"]), float(r["scale"]))
              for r in stats.select("feature", "mean", "scale").collect()}
    return scale_features(df, scaler, keep)


def count_rows(items: list[tuple[str, DataFrame]]) -> DataFrame:
    """(item, n) for a list of named frames, as one union of aggregates."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "n")
             for name, df in items]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
