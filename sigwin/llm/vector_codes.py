"""Operator 12: product codes of vectors; nearest entries by slice-and-intersect bitmasks.

A vector of integers is cut into equal parts, and each part is coded by the number
of its nearest codebook entry.  To find it, the entries' coordinates are sorted in
each dimension, and each place of the order carries the mask of the entries before
it.  The distance to some near entry gives the initial radius; the entries within it
in one dimension are a range of the order, and their mask is the difference of two
prefix masks.  The masks of all dimensions, ANDed, leave the entries in the box of
that radius, which holds every entry as near as that one.  Only these get an exact
integer distance, so the result is exact.

Codebooks are refined by rounds of assigning all parts and taking floored means.  A
task returns sums by entry and component; the driver holds the codebooks, which are
bounded by ``entries`` x the vectors' width.

Defined results: a vector that is null or holds null or non-finite components is
dropped; rows of one vec_id are rows of their own, in the order of their vectors
among the first codebook entries; a null vec_id comes last there; vectors of unequal
width (empty ones too) are padded with zeros up to a multiple of ``parts``; fewer rows
than ``entries`` give as many entries; integer components beyond +-2**53 count as
+-2**53, and sums beyond a long as the largest long; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

import decimal
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigwin.llm.common import broadcast_if_small, matrix, slices, stored

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components beyond this are cut off.
WIDEST = 1 << 53
LONG = (1 << 63) - 1


def integer_vectors(embeddings: DataFrame, label: str = "label", scale: int = SCALE) -> DataFrame:
    """``(vec_id, label, v)``: usable vectors with components ``floor(scale * x)``."""
    e = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    bound = F.lit(float(WIDEST))
    whole = F.transform("e", lambda x: F.floor(F.greatest(F.least(x * F.lit(float(scale)), bound), -bound)))
    return (embeddings.select("vec_id", F.col(label).alias("label"), e.alias("e"))
            .where(F.col("e").isNotNull() & finite).select("vec_id", "label", whole.alias("v")))


class MaskIndex:
    """Up to 64 entries: in each dimension their sorted coordinates and the mask of those before a place."""

    def __init__(self, entries: np.ndarray) -> None:
        order = np.argsort(entries, axis=0, kind="stable")
        self.sorted = np.take_along_axis(entries, order, 0)
        bits = np.bitwise_or.accumulate(np.uint64(1) << order.astype(np.uint64), axis=0)
        self.before = np.vstack([np.zeros((1, entries.shape[1]), np.uint64), bits])
        self.all = np.uint64((1 << len(entries)) - 1)

    def within(self, x: np.ndarray, radius: np.ndarray) -> np.ndarray:
        """For each row of ``x`` the mask of the entries within ``radius`` in every dimension."""
        live = np.full(len(x), self.all, np.uint64)
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            live &= self.before[high, d] ^ self.before[low, d]
        return live


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return ((x - y) ** 2).sum(axis=1)


def _root(squared: np.ndarray) -> np.ndarray:
    """An integer not below the square root."""
    if squared.dtype == object:
        return np.array([math.isqrt(s) + 1 for s in squared.tolist()], object)
    return np.sqrt(squared).astype(np.int64) + 1


def _first_guess(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distance to an entry that is next in one of the two dimensions that spread most."""
    best = _squared(x, book[0])
    spread = book.max(axis=0) - book.min(axis=0)
    for d in np.argsort(-spread.astype(float), kind="stable")[:2].tolist():
        order = np.argsort(book[:, d], kind="stable")
        middle = [(a + b) // 2 for a, b in zip(book[order[:-1], d].tolist(), book[order[1:], d].tolist(), strict=True)]
        near = order[np.searchsorted(np.array(middle, book.dtype), x[:, d], "left")]
        best = np.minimum(best, _squared(x, book[near]))
    return best


def first_distances(x: np.ndarray, index: MaskIndex, book: np.ndarray) -> np.ndarray:
    """For each row the squared distance to some near entry: one of a small box around it if a box of
    one of three sizes holds any, else a neighbour in the dimensions that spread most."""
    best, rest = np.zeros(len(x), x.dtype), np.arange(len(x))
    side = int((book.max(axis=0) - book.min(axis=0)).sum()) // (16 * x.shape[1]) + 1
    for _ in range(3):
        live = index.within(x[rest], side)
        hit, live = rest[live > 0], live[live > 0]
        lowest = np.log2((live & (~live + np.uint64(1))).astype(float)).astype(np.int64)
        best[hit] = _squared(x[hit], book[lowest])
        rest, side = np.setdiff1d(rest, hit, assume_unique=True), 2 * side
    if len(rest):
        best[rest] = _first_guess(x[rest], book)
    return best


def nearest_entries(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For each row of ``x`` its nearest entry (the lowest of a tie), the squared distance, and the
    number of exact distances that the masks left to compute."""
    far = max(abs(int(f(a, initial=0))) for a in (x, book) for f in (np.min, np.max))
    if 4 * far * far * x.shape[1] >= 1 << 62:  # int64 can't hold all squared distances
        x, book = x.astype(object), book.astype(object)
    n = len(x)
    if not n or not x.shape[1]:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    indexes = [MaskIndex(book[start:start + 64]) for start in range(0, len(book), 64)]
    radius = _root(first_distances(x, indexes[0], book))
    chosen, least, computed = np.full(n, -1), np.zeros(n, x.dtype), 0
    for start, index in zip(range(0, len(book), 64), indexes, strict=True):
        live = index.within(x, radius)
        for bit, entry in enumerate(book[start:start + 64]):
            rows = np.flatnonzero(live >> np.uint64(bit) & np.uint64(1))
            distance = _squared(x[rows], entry)
            better = (chosen[rows] < 0) | (distance < least[rows])
            computed += len(rows)
            rows, distance = rows[better], distance[better]
            chosen[rows], least[rows] = start + bit, distance
    return chosen, least, computed


def _assigned(batches: Iterator[pa.RecordBatch], books: list[np.ndarray], width: int, column: int):
    """Slices with, for each part position, the parts, their entries and squared distances."""
    parts = len(books)
    for batch in slices(batches):
        x = matrix(batch.column(column), width * parts, np.int64).reshape(batch.num_rows, parts, width)
        yield batch, [(x[:, p], *nearest_entries(np.ascontiguousarray(x[:, p]), books[p])[:2]) for p in range(parts)]


def _sums(vectors: DataFrame, books: list[np.ndarray], width: int) -> list:
    """Rows ``(part, entry, at, total, n)`` over all vectors."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (len(books), len(books[0]), width)
        total, count = np.zeros(shape, object), np.zeros(shape[:2], np.int64)
        for _, found in _assigned(batches, books, width, 0):
            for p, (x, entry, _) in enumerate(found):
                # A slice's sums stay below 2 ** 63: 512 rows of at most 2 ** 53.
                part = np.zeros(shape[1:], np.int64)
                np.add.at(part, entry, x)
                total[p] += part.astype(object)
                count[p] += np.bincount(entry, minlength=shape[1])
        part, entry, at = (i.ravel() for i in np.indices(shape))
        used = count[part, entry] > 0
        part, entry, at = part[used], entry[used], at[used]
        exact = [decimal.Decimal(int(t)) for t in total[part, entry, at]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in (part, entry, at)]
            + [pa.array(exact, pa.decimal128(38, 0)), pa.array(count[part, entry], pa.int64())],
            ["part", "entry", "at", "total", "n"])

    schema = "part long, entry long, at long, total decimal(38,0), n long"
    return (vectors.select("v").mapInArrow(add, schema).groupBy("part", "entry", "at")
            .agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect())


def fit_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
                  ) -> tuple[list[np.ndarray], int]:
    """The final codebook of each part position, and the parts' width."""
    longest = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts)
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    rows = np.zeros((len(first), width * parts), np.int64)
    for row, (v,) in zip(rows, first, strict=True):
        row[:len(v)] = v
    books = [np.ascontiguousarray(rows[:, p * width:(p + 1) * width]) for p in range(parts)]
    for _ in range(rounds if len(first) and width else 0):
        for r in _sums(vectors, books, width):
            books[r["part"]][r["entry"], r["at"]] = int(r["total"]) // r["n"]
    return books, width


def codebooks_digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(c) for book in books for c in book.ravel().tolist()).encode()).hexdigest()


def encode(vectors: DataFrame, books: list[np.ndarray], width: int) -> DataFrame:
    """``(vec_id, label, code, error)`` of every vector."""
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, found in _assigned(batches, books, width, 2):
            indexes = np.stack([entry for _, entry, _ in found], axis=1).astype(np.uint8)
            error = sum(least.astype(object) for _, _, least in found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([row.tobytes().hex() for row in indexes], pa.string()),
                 pa.array([min(int(e), LONG) for e in error], pa.int64())], ["vec_id", "label", "code", "error"])

    schema = T.StructType([*vectors.select("vec_id", "label").schema.fields, T.StructField("code", T.StringType()),
                           T.StructField("error", T.LongType())])
    return vectors.select("vec_id", "label", "v").mapInArrow(code, schema)


def product_codes(embeddings: DataFrame, label: str = "label", parts: int = PARTS, entries: int = ENTRIES,
                  rounds: int = ROUNDS) -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error, codebooks_sha256."""
    if not 0 < entries <= 256:
        raise ValueError("a code's two hex digits tell 1 to 256 entries apart")
    vectors = stored(integer_vectors(embeddings, label), "vectors")
    books, width = fit_codebooks(vectors, parts, entries, rounds)
    coded = stored(encode(vectors, books, width), "coded")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = stored(coded.groupBy(F.col("label").alias("of")).agg(
        F.least(total, F.lit(LONG).cast("decimal(38,0)")).cast("long").alias("label_error")), "label_errors")
    # One row a label; a hot label's rows are on the other side.
    return coded.join(broadcast_if_small(sums), F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def oracle_sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> str:
    """DuckDB SQL of ``product_codes``: brute-force assignment in every round."""
    width = f"(len(v) // {parts})"
    steps = [f"""
WITH kept AS MATERIALIZED (SELECT vec_id, label, v, row_number() OVER (ORDER BY vec_id, v) AS row
  FROM (SELECT vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding))),
cut AS MATERIALIZED (SELECT row, p, v[p * {width} + 1 : (p + 1) * {width}] AS x FROM kept, range({parts}) r(p)),
b0 AS MATERIALIZED (SELECT p, row - 1 AS k, x AS c FROM cut WHERE row <= {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT row, p, any_value(x) AS x, min(struct_pack(d := d, k := k)) AS best
  FROM (SELECT row, cut.p, x, k, coalesce(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])
  )), 0)::BIGINT AS d FROM cut JOIN b{i} ON cut.p = b{i}.p) GROUP BY row, p)""")
        if i < rounds:
            steps.append(f"""b{i + 1} AS MATERIALIZED (SELECT b{i}.p, b{i}.k, coalesce(m.c, b{i}.c) AS c FROM b{i} LEFT JOIN (
  SELECT p, k, list(floor(total / n)::BIGINT ORDER BY place) AS c FROM (
    SELECT p, k, place, sum(e)::DOUBLE AS total, count(*) AS n FROM (
      SELECT p, best.k AS k, unnest(x) AS e, generate_subscripts(x, 1) AS place FROM a{i}) GROUP BY p, k, place)
  GROUP BY p, k) m ON b{i}.p = m.p AND b{i}.k = m.k)""")
    steps.append(f"""coded AS (SELECT row, string_agg(printf('%02x', best.k), '' ORDER BY p) AS code,
  sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY row),
digest AS (SELECT sha256(string_agg(e::VARCHAR, ',' ORDER BY p, k, place)) AS codebooks_sha256 FROM (
  SELECT p, k, unnest(c) AS e, generate_subscripts(c, 1) AS place FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row), digest""")
    return ",\n".join(steps)
