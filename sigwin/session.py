"""Session helpers.

The library never creates a session on its own inside an operator; these are
for tests, the bench and scripts.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "sigwin") -> SparkSession:
    master = master or os.environ.get("SIGWIN_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.driver.memory", os.environ.get("SIGWIN_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder of the session for checkpoints and written tables.

    ``spark.checkpoint.dir`` names it.  Where it is unset, a scratch folder is made
    only for a ``local`` master (tests, bench), whose executors share this machine's
    disk; on a cluster it is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if not current:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current:
        return current.rstrip("/")
    if not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="sigwin-ckpt-"))
    return sc.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes that may be broadcast where ``sigwin.broadcast.maxBytes`` says nothing.
DEFAULT_BROADCAST_BYTES = 64 << 20


def broadcast_bytes(spark: SparkSession) -> int:
    """The one limit of what the library broadcasts, in bytes of the hashed rows."""
    return int(spark.conf.get("sigwin.broadcast.maxBytes", None) or DEFAULT_BROADCAST_BYTES)


def _value_bytes(field: T.StructField):
    """An expression of the bytes a value takes beside the row's fixed part."""
    column = F.col("`" + field.name.replace("`", "``") + "`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(column), F.lit(0)).cast("long")
    if isinstance(field.dataType, (T.ArrayType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0)).cast("long") * 2
    return F.lit(0).cast("long")


def table_bytes(df: DataFrame, row_bytes: int | None = None) -> int:
    """The bytes ``df`` takes as a broadcast hash table, counted in one job.

    Each row counts as ``row_bytes``, or 32 bytes, 16 more a column, and the lengths of its
    strings, binaries and arrays.
    """
    if row_bytes is not None:
        return df.count() * row_bytes
    sizes = [_value_bytes(f) for f in df.schema.fields]
    rows, values = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(sum(sizes[1:], sizes[0])), F.lit(0))).first()
    return int(rows) * (32 + 16 * len(df.columns)) + int(values)
