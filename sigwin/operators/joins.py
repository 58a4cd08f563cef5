"""Join helpers: broadcast a side only behind a check of its bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigwin.session import broadcast_bytes, stored, table_bytes


def broadcast_if_small(df: DataFrame, max_bytes: int | None = None, name: str = "side") -> DataFrame:
    """Store ``df`` in the shared folder and mark it for broadcast if its bytes are within
    ``max_bytes`` (``sigwin.broadcast.maxBytes`` by default).  Beyond that the stored table
    is returned and Spark plans a shuffle join (AQE splits skewed partitions)."""
    limit = broadcast_bytes(df.sparkSession) if max_bytes is None else max_bytes
    df = stored(df, name)
    return F.broadcast(df) if table_bytes(df) <= limit else df
