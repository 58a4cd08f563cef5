"""Operator 7: exact top-k by inner product with multi-resolution segment statistics.

For vectors cut into segments of n components with means m and deviations s,
``|x - y|^2 >= sum n * ((mx - my)^2 + (sx - sy)^2)``; finer segments give tighter
bounds.  As ``<x, y> = (|x|^2 + |y|^2 - |x - y|^2) / 2``, a lower bound of the
distance is an upper bound of the score.  Components are ordered by variance over all
vectors, the largest first, and each vector's statistics at all levels are made once.
Candidates are cut coarse to fine against the k-th best score known so far, and
survivors get the exact integer score.

Blocks of queries meet slices of candidates in rounds (``rounds``), so a query's threshold
comes from all rows so far and not from one slice.  Of candidates with one and the same
vector only the ``k + 1`` of the smallest vec_id take part: they tie.

Defined results: vectors that are null or hold null or non-finite components take no
part; an empty vector scores 0 with everything; rows of one vec_id are candidates and
queries of their own, and only the query's own row is left out; a null vec_id is no
query and comes last among equal scores; vectors of unequal length score as if padded
with zeros; scores beyond a long are the nearest long; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigwin.llm.common import matrix, slices, stored
from sigwin.llm.rounds import best_in_rounds, few_copies, found_table, merged

SCALE = 256
QUERY_EVERY = 50
K = 5
#: Rows of a block of queries and of a slice of candidates: bounds what a group holds.
QUERY_ROWS = 1024
SLICE_ROWS = 8192
#: Queries of a tile, and the share of live candidates below which bounds are computed for these only.
TILE, FEW = 256, 0.05
#: Segment counts, coarse to fine.
LEVELS = (4, 16, 32, 48)
#: Integers up to here are exact as doubles, and as sums of doubles below it.
EXACT = 1 << 53
LONG = (1 << 63) - 1


def whole_numbers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` as doubles; exact below ``EXACT``."""
    with np.errstate(over="ignore"):
        return np.floor(x * float(scale))


def exact_numbers(x: np.ndarray, scale: int = SCALE) -> list[int]:
    """``floor(scale * x)`` of one vector of any size."""
    return [math.floor(scale * Fraction(v)) for v in x.tolist()]


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, times the root of the segment's length.

    The Euclidean distance of two such rows is the lower bound of the vectors' distance.
    """
    if not x.shape[1]:
        return np.zeros((len(x), 2))
    parts = np.array_split(x, min(segments, x.shape[1]), axis=1)
    return np.hstack([np.stack([p.mean(1), p.std(1)], 1) * np.sqrt(p.shape[1]) for p in parts])


def all_statistics(v: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The squared length and the statistics of all levels, one row a vector."""
    x = v[:, order]
    with np.errstate(all="ignore"):
        return np.hstack([(x * x).sum(1)[:, None], *[segment_statistics(x, n) for n in LEVELS]])


def level_columns(width: int) -> list[slice]:
    """Which columns of ``all_statistics`` belong to each level."""
    ends = np.cumsum([1, *[2 * max(1, min(n, width)) for n in LEVELS]]).tolist()
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def upper_bounds(q: np.ndarray, c: np.ndarray, level: slice) -> np.ndarray:
    """Upper bounds of the scores of queries (rows) with candidates (columns) from their statistics at one
    level, with room for rounding."""
    with np.errstate(all="ignore"):
        x, y = q[:, level], c[:, level]
        lower = (x * x).sum(1)[:, None] + (y * y).sum(1) - 2 * (x @ y.T)
        size = q[:, :1] + c[:, 0]
        bound = (size - lower) / 2 + 1e-9 * size + 1e-6
    bound[np.isnan(bound)] = np.inf  # lengths beyond doubles bound nothing
    return bound


def exact_scores(c: np.ndarray, q: np.ndarray) -> list[int]:
    """Integer scores of vectors ``c`` with vector ``q``, cut off at what a long holds."""
    whole, query = whole_numbers(c), whole_numbers(q)
    far = np.abs(whole).max(axis=1, initial=0) * np.abs(query).max(initial=0) * max(1, c.shape[1])
    near = far < EXACT  # every product and sum is exact
    out = [0] * len(c)
    for i, s in zip(np.flatnonzero(near).tolist(), (whole[near] @ query).tolist() if near.any() else [], strict=True):
        out[i] = int(s)
    if not near.all():
        query = exact_numbers(q)
        for i in np.flatnonzero(~near).tolist():
            score = sum(a * b for a, b in zip(exact_numbers(c[i]), query, strict=True))
            out[i] = max(-LONG - 1, min(LONG, score))
    return out


def best_of_slice(q: np.ndarray, qs: np.ndarray, c: np.ndarray, cs: np.ndarray, own: np.ndarray, floor: list, k: int
                  ) -> Iterator[tuple[np.ndarray, list[int], int]]:
    """For each query (places, scores) of the candidates that can be among its k best, and how many
    scores were computed.  ``own`` is each query's own place, or -1; ``floor`` its k-th best score so far.

    A level's bounds are one matrix product for a tile of queries while it still has many
    candidates, and computed for the ones that are left when they are few.
    """
    levels = level_columns(c.shape[1])
    for at in range(0, len(q), TILE):
        tile = range(at, min(at + TILE, len(q)))
        bound = upper_bounds(qs[tile.start:tile.stop], cs, levels[0])
        known, computed = np.full(len(tile), -np.inf), [0] * len(tile)
        for t, i in enumerate(tile):
            if own[i] >= 0:
                bound[t, own[i]] = -np.inf
            if floor[i] is not None:
                known[t] = floor[i]
            elif len(c) > 4 * k + 1:
                # The candidates with the best coarse bounds give the first threshold.
                first = np.argpartition(-bound[t], 4 * k)[:4 * k]
                first = first[first != own[i]]
                known[t], computed[t] = sorted(exact_scores(c[first], q[i]))[-k], len(first)
        live = (bound >= known[:, None]) & (bound > -np.inf)
        for level in levels[1:]:
            if live.mean() > FEW:
                live &= upper_bounds(qs[tile.start:tile.stop], cs, level) >= known[:, None]
            else:
                for t, i in enumerate(tile):
                    rows = np.flatnonzero(live[t])
                    live[t, rows] = upper_bounds(qs[i:i + 1], cs[rows], level)[0] >= known[t]
        for t, i in enumerate(tile):
            rows = np.flatnonzero(live[t])
            yield rows, exact_scores(c[rows], q[i]), computed[t] + len(rows)


def prepared_vectors(embeddings: DataFrame, query_every: int = QUERY_EVERY) -> DataFrame:
    """Stored ``(row, vec_id, asked, e, stats)`` of the usable vectors."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    asked = F.coalesce(F.col("vec_id") % query_every == 0, F.lit(False))
    kept = stored(embeddings.select(F.col("vec_id").cast("long"), e.alias("e")).where(F.col("e").isNotNull() & finite)
                  .select(F.monotonically_increasing_id().alias("row"), "vec_id", asked.alias("asked"), "e"), "vectors")
    width = kept.agg(F.coalesce(F.max(F.size("e")), F.lit(0))).first()[0]
    # Variances over all vectors, shorter ones as if padded; what is collected is one number a component.
    spread = (kept.select(F.posexplode("e").alias("at", "x")).groupBy("at")
              .agg(F.sum(F.col("x") * F.col("x")).alias("s2"), F.sum("x").alias("s"), F.count(F.lit(1)).alias("n")).collect())
    n = max([r["n"] for r in spread], default=1)
    variance = np.zeros(width)
    for r in spread:
        with np.errstate(all="ignore"):  # any order gives the same result
            variance[r["at"]] = np.nan_to_num(np.float64(r["s2"]) / n - (np.float64(r["s"]) / n) ** 2, nan=0.0)
    order = np.argsort(-variance, kind="stable")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if batch.num_rows:
                stats = all_statistics(whole_numbers(matrix(batch.column(3), width, np.float64)), order)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([s.tobytes() for s in stats], pa.binary())],
                                                 ["row", "vec_id", "asked", "e", "stats"])

    schema = "row long, vec_id long, asked boolean, e array<double>, stats binary"
    return stored(kept.mapInArrow(add, schema), "prepared")


def _cell(k: int, width: int):
    """The function of a cell of queries and candidates."""
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return found_table([], "long")
        (q, qs), (c, cs) = ((matrix(t["e"].combine_chunks(), width, np.float64),
                             np.array([np.frombuffer(s, float) for s in t["stats"].to_pylist()])) for t in (left, right))
        place = {row: i for i, row in enumerate(right["row"].to_pylist())}
        qrow, qid, crow, cid = (t[n].to_pylist() for t in (left, right) for n in ("row", "vec_id"))
        own = np.array([place.get(row, -1) for row in qrow])
        rows, floor = [], left["floor"].to_pylist()
        for i, (live, scores, _) in enumerate(best_of_slice(q, qs, c, cs, own, floor, k)):
            found = ((qrow[i], s, cid[j], crow[j]) for s, j in zip(scores, live.tolist(), strict=True))
            rows += [(qrow[i], qid[i], vec_id, row, s) for top in merged(found, k).values() for s, vec_id, row in top]
        return found_table(rows, "long")
    return cell


def top_k(embeddings: DataFrame, k: int = K, query_every: int = QUERY_EVERY,
          query_rows: int = QUERY_ROWS, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Per query its k best candidates: query_id, rank, vec_id, score."""
    vectors = prepared_vectors(embeddings, query_every)
    n, q, width = vectors.agg(F.count(F.lit(1)), F.count(F.when(F.col("asked"), 1)),
                              F.coalesce(F.max(F.size("e")), F.lit(0))).first()
    candidates = stored(few_copies(vectors, "e", k).drop("asked"), "candidates")
    return best_in_rounds(vectors.where("asked").drop("asked"), candidates, q, n, k, _cell(k, width), "long",
                          query_rows, slice_rows, "top-k")


ORACLE = """
WITH v AS (SELECT vec_id, row_number() OVER () AS row,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.row AS qrow, c.row AS crow, q.vec_id AS query_id, c.vec_id AS vec_id,
  CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY qrow ORDER BY score DESC, vec_id, crow) AS INTEGER) AS rank,
  vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
