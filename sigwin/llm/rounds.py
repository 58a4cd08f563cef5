"""The k best candidates of every query, by blocks of queries and rounds of candidate slices.

Queries are dealt into blocks and candidates into slices of bounded size; a (block,
slice) cell is one group.  Slices are joined in rounds, each of ``GROWTH`` times as many
as before it.  After a round a query knows its k-th best score among all rows so far
(its floor), and what a cell returns are only rows that can still be among the k best;
they are merged by a heap for each query.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigwin.llm.common import stored

#: Slices of a round as a multiple of those before it.
GROWTH = 4
#: Queries whose heaps share a group.
HEAPS = 64


def _order(score: float, vec_id: int | None, row: int) -> tuple:
    """Sorts results: high scores first, ties to the smaller vec_id, null last, then by row."""
    return -score, vec_id is None, vec_id or 0, row


def merged(rows: Iterator[tuple], k: int) -> dict[int, list[tuple]]:
    """The k best of each query among ``(query row, score, vec_id, row)``, best first, by a heap a query."""
    heaps: dict[int, list] = {}
    for query, score, vec_id, row in rows:
        heap = heaps.setdefault(query, [])
        entry = tuple(-p for p in _order(score, vec_id, row))  # the worst of the heap comes first
        if len(heap) < k:
            heapq.heappush(heap, (entry, score, vec_id, row))
        elif entry > heap[0][0]:
            heapq.heapreplace(heap, (entry, score, vec_id, row))
    return {q: [x[1:] for x in sorted(heap, key=lambda x: x[0], reverse=True)] for q, heap in heaps.items()}


def found_schema(score: str) -> str:
    return f"qrow long, query_id long, vec_id long, crow long, score {score}"


def found_table(rows: list[tuple], score: str) -> pa.Table:
    """Rows ``(qrow, query_id, vec_id, crow, score)`` as a table; ``score`` is ``long`` or ``double``."""
    kinds = [pa.int64()] * 4 + [pa.int64() if score == "long" else pa.float64()]
    names = [c.split()[0] for c in found_schema(score).split(", ")]
    return pa.table({n: pa.array([r[i] for r in rows], kind) for i, (n, kind) in enumerate(zip(names, kinds, strict=True))})


def _merge(found: DataFrame, k: int, groups: int, score: str) -> DataFrame:
    """The k best rows of each query: a group streams its queries' rows through heaps."""
    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: dict[int, int] = {}

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for qrow, query_id, vec_id, crow, value in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
                    ids[qrow] = query_id
                    yield qrow, value, vec_id, crow

        out = [(q, ids[q], vec_id, row, value) for q, top in merged(rows(), k).items() for value, vec_id, row in top]
        yield from found_table(out, score).to_batches()

    return found.select("qrow", "query_id", "vec_id", "crow", "score", F.pmod(F.xxhash64("qrow", F.lit(2)), F.lit(groups))
                        .alias("g")).groupBy("g").applyInArrow(best, found_schema(score))


def best_in_rounds(queries: DataFrame, candidates: DataFrame, n_queries: int, n_candidates: int, k: int, cell: Callable,
                   score: str, query_rows: int, slice_rows: int, name: str) -> DataFrame:
    """Per query its k best candidates: query_id, rank, vec_id, score.

    Both tables have ``row`` (unique) and ``vec_id`` and are stored.  ``cell(left, right)`` gets the
    queries of a block, with ``floor`` (null, or the k-th best score so far), and the candidates of a
    slice, as Arrow tables, and returns a ``found_table``.
    """
    blocks, parts = max(1, -(-n_queries // query_rows)), max(1, -(-n_candidates // slice_rows))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(blocks)))
    candidates = candidates.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))

    def each(low: int, high: int) -> Column:
        return F.explode(F.sequence(F.lit(low).cast("long"), F.lit(high - 1).cast("long")))

    groups = max(1, -(-n_queries // HEAPS))
    best, done = None, 0
    while done < parts:
        upto = min(parts, max(1, done * (1 + GROWTH)))
        if best is None:
            asked = queries.withColumn("floor", F.lit(None).cast(score))
        else:
            floors = (best.groupBy(F.col("qrow").alias("row")).agg(F.min("score").alias("floor"), F.count(F.lit(1)).alias("m"))
                      .where(F.col("m") == k).select("row", "floor"))
            asked = queries.join(floors, "row", "left")
        left = asked.select("*", each(done, upto).alias("part"))
        right = candidates.where(F.col("part").between(done, upto - 1)).select("*", each(0, blocks).alias("block"))
        found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(cell, found_schema(score))
        best = stored(_merge(found if best is None else found.unionByName(best), k, groups, score), name)
        done = upto
    ranks = Window.partitionBy("qrow").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "crow")
    return best.withColumn("rank", F.row_number().over(ranks)).select("query_id", "rank", "vec_id", "score")


def few_copies(vectors: DataFrame, by: str, k: int) -> DataFrame:
    """Of rows with one and the same vector the ``k + 1`` of the smallest vec_id.

    Copies score equally with everything, so only these can be among the k best of a query
    (one of them may be the query's own row).
    """
    copies = Window.partitionBy(by).orderBy(F.col("vec_id").asc_nulls_last(), "row")
    return vectors.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).drop("copy")
