"""Site tables stored in the layout that windows need.

The table holds each site once for every position bucket it is needed in (its own, and
the neighbouring one within the radius of an edge), clustered by (contig, bucket) and
sorted by position.  Windows over it need no exchange: whoever reads the table, in
whatever job, finds the rows of a window's group in one file.  ``layout`` beside the
rows says how they were cut.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigwin import schemas as S
from sigwin.operators import windows as W

#: Files of a table; each holds about this many buckets' share of the rows.
FILES = 200
LAYOUT = "files int, bucket long, radius int"


def _columns() -> T.StructType:
    return T.StructType([*S.SITE_SCHEMA.fields, T.StructField(W.BUCKET_COL, T.LongType())])


def write_clustered_sites(sites: DataFrame, path: str, files: int = FILES, bucket: int = W.DEFAULT_BUCKET) -> None:
    """One shuffle by (contig, bucket), one file for each of ``files`` groups of buckets."""
    spark = sites.sparkSession
    staged = W.staged_sites(sites.select(*S.SITE_SCHEMA.names), S.RADIUS, bucket)
    name = f"sites_{uuid.uuid4().hex}"
    (staged.repartition(files, "contig", W.BUCKET_COL).write.mode("overwrite").format("parquet").option("path", f"{path}/rows")
     .bucketBy(files, "contig", W.BUCKET_COL).sortBy("contig", W.BUCKET_COL, "position").saveAsTable(name))
    spark.sql(f"DROP TABLE {name}")  # the files stay: the table is external
    spark.createDataFrame([(files, bucket, S.RADIUS)], LAYOUT).write.mode("overwrite").parquet(f"{path}/layout")


def read_clustered_sites(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows, with their bucket (``W.BUCKET_COL``); ``W.context_windows`` takes them as they are."""
    layout = spark.read.parquet(f"{path}/layout").first()
    name = f"sites_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _columns().fields)
    by = f"contig, {W.BUCKET_COL}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}, position) "
              f"INTO {layout['files']} BUCKETS LOCATION '{path}/rows'")
    return spark.table(name)


def sites_of(clustered: DataFrame, bucket: int = W.DEFAULT_BUCKET) -> DataFrame:
    """Each site once: the rows of its own bucket."""
    return clustered.where(F.col(W.BUCKET_COL) == F.floor(F.col("position") / F.lit(bucket))).drop(W.BUCKET_COL)
