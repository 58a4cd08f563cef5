"""Operator 13: nearest neighbours by cosine as a block matrix join over int8 tiles.

A vector of length 1 is written as ``scale * code + rest`` with int8 codes, and the
length of the rest is kept.  For two vectors x and y,

    |<x, y> - scale_x scale_y <code_x, code_y>| <= |scale_x code_x| |rest_y| + |rest_x|

so the product of two int8 tiles gives every pair's cosine with an error bound.  A
pair survives if its upper bound reaches the k-th best cosine known of its query;
survivors are recomputed in double precision from the original vectors and merged by
heaps.  The result is exact, so recall is 1.

Blocks of queries meet slices of candidates in rounds (``rounds``): after a round a query
knows its k-th best cosine among all rows so far, and only about ``k * GROWTH`` of the
next round's rows can beat it, however many there are.  Of candidates with one and the
same vector only the ``k + 1`` of the smallest vec_id take part.

Defined results: vectors that are null, empty, all zero, or hold null or non-finite
components take no part; rows of one vec_id are candidates and queries of their own,
and only the query's own row is left out; a null vec_id is no query and comes last
among equal scores; vectors of unequal length are compared as if padded with zeros;
fewer candidates than k are all returned; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigwin.llm.common import matrix, slices, stored
from sigwin.llm.rounds import best_in_rounds, few_copies, found_table, merged

K, QUERY_EVERY = 5, 50
#: Rows of a block of queries and of a slice of candidates: bounds what a group holds.
QUERY_ROWS, SLICE_ROWS = 2048, 8192
#: Queries of a tile.
TILE = 256
#: Dimensions whose int8 products add up exactly in float32.
EXACT = 1024
#: Room for rounding in bounds that are compared with exact cosines.
SLACK = 1e-9


def unit_vectors(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; first scaled by a power of two, so that squares neither over- nor underflow."""
    _, exponent = np.frexp(np.abs(x).max(axis=1, initial=0))
    x = np.ldexp(x, -exponent[:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def int8_codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of rows of length 1, their scales, and the lengths of what the codes leave out."""
    scale = np.abs(unit).max(axis=1, initial=0) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    rest = np.sqrt(((unit - scale[:, None] * code) ** 2).sum(axis=1))
    return code, scale, rest


def tile_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of the rows of two int8 matrices."""
    out = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT):
        out += a[:, at:at + EXACT].astype(np.float32) @ b[:, at:at + EXACT].astype(np.float32).T
    return out


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of the rows of ``x`` with those of ``y``, sums from left to right: equal vectors, equal results."""
    def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.cumsum(a * b, axis=1)[:, -1]

    shift = [np.frexp(np.abs(v).max(axis=1, initial=0))[1] for v in (x, y)]
    # Only vectors whose squares may not fit are scaled, by powers of two; the others stay as they are.
    x, y = (np.ldexp(v, np.where(np.abs(s) > 400, -s, 0)[:, None]) for v, s in zip((x, y), shift, strict=True))
    return dot(x, y) / (np.sqrt(dot(x, x)) * np.sqrt(dot(y, y)))


def cell_survivors(floor: np.ndarray, query: tuple, candidate: tuple, own: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each query the places of the candidates whose upper bound reaches its floor and the k-th lower bound
    here.  ``query`` and ``candidate`` are codes, scales, rests; ``own`` is each query's own place, or -1."""
    (qc, qs, qr), (cc, cs, cr) = query, candidate
    reach = np.sqrt((cc.astype(float) ** 2).sum(axis=1)) * cs
    for at in range(0, len(qc), TILE):
        tile = slice(at, at + TILE)
        middle = tile_products(qc[tile], cc) * qs[tile, None] * cs
        error = qr[tile, None] * reach + cr
        for i, (m, e) in enumerate(zip(middle, error, strict=True), start=at):
            if own[i] >= 0:
                m[own[i]], e[own[i]] = -np.inf, 0
            known = floor[i]
            if len(m) > k:
                lower = m - e
                known = max(known, lower[np.argpartition(lower, len(lower) - k)[len(lower) - k]])
            live = np.flatnonzero(m + e >= known - SLACK)
            yield live[live != own[i]]


def coded_vectors(embeddings: DataFrame, query_every: int = QUERY_EVERY) -> DataFrame:
    """Stored ``(row, vec_id, asked, e, code, scale, rest)`` of the usable vectors; codes are made once."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    usable = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = (embeddings.select(F.col("vec_id").cast("long"), e.alias("e"))
            .where(F.col("e").isNotNull() & usable & F.exists("e", lambda x: x != 0))
            .withColumn("row", F.monotonically_increasing_id())
            .withColumn("asked", F.coalesce(F.col("vec_id") % query_every == 0, F.lit(False)))
            .select("row", "vec_id", "asked", "e"))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if not batch.num_rows:
                continue
            lists = batch.column(3)
            x = matrix(lists, int(np.diff(lists.offsets.to_numpy()).max()), np.float64)
            codes, scale, rest = int8_codes(unit_vectors(x))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(scale), pa.array(rest)],
                ["row", "vec_id", "asked", "e", "code", "scale", "rest"])

    schema = "row long, vec_id long, asked boolean, e array<double>, code binary, scale double, rest double"
    return stored(kept.mapInArrow(code, schema), "coded")


def _codes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int8)
    for row, code in zip(out, column.to_pylist(), strict=True):
        row[:len(code)] = np.frombuffer(code, np.int8)[:width]
    return out


def _cell(k: int):
    """The function of a cell: the k best candidates of each query here that can be among its k best of all."""
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return found_table([], "double")
        width = int(max(np.diff(t["e"].combine_chunks().offsets.to_numpy()).max() for t in (left, right)))
        x, y = (matrix(t["e"].combine_chunks(), width, np.float64) for t in (left, right))
        query, candidate = ((_codes(t["code"], width), t["scale"].to_numpy(), t["rest"].to_numpy()) for t in (left, right))
        qrow, crow = left["row"].to_numpy(), right["row"].to_numpy()
        qid, cid = left["vec_id"].to_pylist(), right["vec_id"].to_pylist()
        place = {row: i for i, row in enumerate(crow.tolist())}
        own = np.array([place.get(row, -1) for row in qrow.tolist()])
        floor = left["floor"].fill_null(-np.inf).to_numpy()
        ux, uy = unit_vectors(x), unit_vectors(y)
        rows = []
        for i, live in enumerate(cell_survivors(floor, query, candidate, own, k)):
            if not len(live):
                continue
            near = uy[live] @ ux[i]
            known = floor[i]
            if len(live) > k:
                known = max(known, near[np.argpartition(near, len(near) - k)[len(near) - k]])
            live = live[near >= known - SLACK]
            scores = cosines(np.broadcast_to(x[i], (len(live), width)), y[live])
            found = ((int(qrow[i]), s, cid[c], int(crow[c])) for s, c in zip(scores.tolist(), live.tolist(), strict=True))
            rows += [(q, qid[i], vec_id, row, score) for q, best in merged(found, k).items()
                     for score, vec_id, row in best]
        return found_table(rows, "double")
    return cell


def nearest(embeddings: DataFrame, k: int = K, query_every: int = QUERY_EVERY, query_rows: int = QUERY_ROWS,
            slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Per query its k nearest candidates: query_id, rank, vec_id, score."""
    vectors = coded_vectors(embeddings, query_every)
    n, q = vectors.agg(F.count(F.lit(1)), F.count(F.when(F.col("asked"), 1))).first()
    candidates = stored(few_copies(vectors, "e", k).drop("asked"), "candidates")
    return best_in_rounds(vectors.where("asked").drop("asked"), candidates, q, n, k, _cell(k), "double",
                          query_rows, slice_rows, "nearest")


ORACLE = """
WITH v AS (SELECT vec_id, row_number() OVER () AS row, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
  AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.row AS qrow, c.row AS crow, q.vec_id AS query_id, c.vec_id AS vec_id,
  list_dot_product(q.e, c.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(c.e, c.e))) AS score
  FROM v q JOIN v c ON q.row <> c.row WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY qrow ORDER BY score DESC, vec_id, crow) AS INTEGER) AS rank,
  vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
