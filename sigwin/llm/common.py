"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigwin.session import broadcast_bytes, ensure_checkpoint_dir, table_bytes


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the session's ``spark.checkpoint.dir``, which all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int | None = None) -> DataFrame:
    """``df``, a stored table, to be broadcast if its bytes allow (``sigwin.broadcast.maxBytes``).

    ``row_bytes`` bounds a row of fixed width; without it the values' lengths are summed.
    """
    return F.broadcast(df) if table_bytes(df, row_bytes) <= broadcast_bytes(df.sparkSession) else df


def fresh_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted`` names, with as many underscores before all of them as keep them apart from ``taken``."""
    lower, mark = {t.lower() for t in taken}, "_"
    while any((mark + w).lower() in lower for w in wanted):
        mark += "_"
    return [mark + w for w in wanted]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def ascii_lower(column: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_COMPRESSOR, _DECOMPRESSOR = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(data: bytes) -> bytes:
    return _COMPRESSOR.compress(data)


def unpack(data: bytes) -> bytes:
    return _DECOMPRESSOR.decompress(data)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(),
          "binary": pa.binary(), "boolean": pa.bool_()}


def arrow_schema(schema: str) -> pa.Schema:
    """The Arrow schema of ``name type, ...`` for the simple types the operators return."""
    return pa.schema([(name, _ARROW[kind]) for name, kind in map(str.split, schema.split(","))])


#: Rows of text that a worker holds as Python objects at once.
SLICE = 512
#: Tasks whose partial sums are added up together before all are.
SUMMED = 256


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``SLICE`` rows; in the end the worker gives free memory back."""
    for b in batches:
        yield from (b.slice(at, SLICE) for at in range(0, b.num_rows, SLICE))
    pa.default_memory_pool().release_unused()


def task_batch() -> int:
    """The number of this task's batch in ``added_up``."""
    return TaskContext.get().partitionId() // SUMMED


def added_up(partial: DataFrame, schema: str, add: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
             ) -> DataFrame:
    """Partial sums by ``chunk``, added first by ``batch`` (``task_batch``) and then in all.

    ``add`` is typed as an iterator of record batches, so a group is streamed: a task holds
    a batch of rows and one sum, however many tasks there were.
    """
    for keys in (("chunk", "batch"), ("chunk",)):
        partial = partial.groupBy(*keys).applyInArrow(add, schema)
    return partial


def matrix(lists: pa.ListArray, width: int, dtype: type) -> np.ndarray:
    """A list column as a matrix of ``width`` columns; shorter lists are padded with zeros."""
    out = np.zeros((len(lists), width), dtype)
    sizes = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(len(lists)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row, at] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def map_rows(df: DataFrame, schema: str, function: Callable[..., dict]) -> DataFrame:
    """``mapInArrow`` over the rows of ``df``, batch by batch.

    ``function`` gets one Python list for each column of ``df`` and returns the
    output columns by name.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict(function(*(c.to_pylist() for c in batch.columns)), schema=arrow)
    return df.mapInArrow(run, schema)
