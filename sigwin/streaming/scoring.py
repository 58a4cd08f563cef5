"""Scoring window files as they arrive.

The reference has no streaming operator.  Its prediction step (finite filter
-> scaling -> both models -> mean) is stateless per row, so the same plan
runs unchanged on a streaming DataFrame: new window files in a folder are
scored and appended to a sink, with progress kept in a checkpoint location
(restart-safe, exactly-once file sink).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from sigwin import schemas as S
from sigwin.operators import models as ML


def window_stream(spark: SparkSession, source: str, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(S.WINDOW_SCHEMA).format(fmt)
    if fmt == "csv":
        reader = reader.option("sep", "\t").option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(source)


def score_stream(spark: SparkSession, fitted: ML.FittedEnsemble, source: str, sink: str,
                 checkpoint: str, fmt: str = "parquet", available_now: bool = True
                 ) -> StreamingQuery:
    """Start a query that predicts every window file under ``source`` and
    appends the prediction table to ``sink`` (Parquet)."""
    pred = ML.predict(window_stream(spark, source, fmt), fitted)
    writer = (pred.writeStream.format("parquet").outputMode("append")
              .option("path", sink).option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="30 seconds")
    return writer.start()
