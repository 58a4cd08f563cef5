"""Operator 11: importance resampling towards a target distribution.

A 256-byte table lower-cases A-Z and blanks separators in the UTF-8 bytes of a
text, ``bytes.split`` yields its words, and longer features extend the crc32 of
a run of words by a blank and the next word (the crc of the run is the seed).
Counters reduce a task's words before they become bucket counts.  Documents and
target texts are counted into the same buckets; a bucket's gain is the logarithm
of how much likelier it is in the target, and a document's weight is the sum of
its features' gains.  A seeded Gumbel noise is added and the best share is drawn:
a draw without repeats by importance.

The gains are one integer a bucket, so what travels to the tasks is bounded by
``buckets``.  The draw is a range sort of a few numbers a row with offsets of its
partitions; no task or driver holds more than a partition.

Defined results: a null or empty text has no features and weight 0; a null doc_id
is hashed as the empty string and comes last among equal scores; repeated rows have
equal scores and their own ranks; a null target text counts as empty; without target
texts all of T is 0; an empty table gives no rows; other columns are not read by
``importance_report`` and are returned as they are by ``resampled``.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigwin.llm.common import fresh_names, slices, stored

#: Longest run of words that is a feature, buckets, seed of the noise.
RUNS, BUCKETS, SEED = 1, 10_000, 2024
#: Documents with at least so many words are drawn from, so many in a hundred.
MIN_WORDS, PERCENT = 20, 10
#: Distinct words (or runs) that a task holds before they go to their buckets.
HELD = 1 << 18

#: Bytes of words stay (A-Z as a-z), all others become a blank.
KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
             for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(KEPT).split()


def longer_runs(words: list[bytes], runs: int) -> Iterator[list[int]]:
    """The crc32 of all runs of 2 words, of 3 words, up to ``runs`` words."""
    seeds = list(map(crc32, words)) if runs > 1 else []
    for k in range(1, runs):
        seeds = [crc32(word, crc32(b" ", seed)) for seed, word in zip(seeds, words[k:], strict=False)]
        yield seeds


def bucket_counts(texts: Iterable[bytes | None], runs: int, buckets: int) -> np.ndarray:
    """How many features of the texts fall into each bucket."""
    total, words_seen, runs_seen = np.zeros(buckets, np.int64), Counter(), Counter()

    def flush() -> None:
        for hashes, counts in ((map(crc32, words_seen), words_seen), (runs_seen, runs_seen)):
            at = np.fromiter(hashes, np.int64, len(counts)) % buckets
            np.add.at(total, at, np.fromiter(counts.values(), np.int64, len(counts)))
        words_seen.clear()
        runs_seen.clear()

    for text in texts:
        words = words_of(text)
        words_seen.update(words)
        for run in longer_runs(words, runs):
            runs_seen.update(run)
        if len(words_seen) + len(runs_seen) > HELD:
            flush()
    flush()
    return total


def _texts(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[bytes | None]:
    for batch in slices(batches):
        yield from batch.column(column).cast(pa.binary()).to_pylist()


def corpus_counts(df: DataFrame, runs: int = RUNS, buckets: int = BUCKETS) -> list[int]:
    """Features by bucket of all texts: each task's counts (at most ``buckets`` rows), added up."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = bucket_counts(_texts(batches, 0), runs, buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["bucket", "n"])

    rows = (df.select(F.col("text").cast("string")).mapInArrow(count, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = [0] * buckets
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: list[int], target: list[int]) -> list[int]:
    """Thousandths of the log ratio of smoothed shares, floored, for each bucket."""
    s_all, t_all = float(sum(source) + len(source)), float(sum(target) + len(source))
    return [math.floor(1000 * math.log((float(t + 1) * s_all) / (float(s + 1) * t_all)))
            for s, t in zip(source, target, strict=True)]


class _WordGains(dict):
    """word -> gain of its bucket; made when asked for, forgotten when there are too many."""

    def __init__(self, gains: list[int]) -> None:
        super().__init__()
        self.gains = gains

    def __missing__(self, word: bytes) -> int:
        gain = self.gains[crc32(word) % len(self.gains)]
        if len(self) < HELD:
            self[word] = gain
        return gain


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths from the first 32 bits of the seeded sha256 of the id."""
    h = int(sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: list[int], keep: list[str], names: list[str], runs: int, seed: int) -> DataFrame:
    """Columns ``keep`` of ``docs`` and, called ``names``, each row's words, features, weight and score."""
    fields = [f for f in docs.select(*keep).schema.fields] + [T.StructField(n, T.LongType()) for n in names]
    kept, buckets = len(keep), len(gains)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_gains = _WordGains(gains)
        for batch in slices(batches):
            rows = []
            ids, texts = batch.column(kept).to_pylist(), batch.column(kept + 1).cast(pa.binary()).to_pylist()
            for doc_id, text in zip(ids, texts, strict=True):
                words = words_of(text)
                weight, features = sum(map(word_gains.__getitem__, words)), len(words)
                for run in longer_runs(words, runs):
                    weight += sum(gains[h % buckets] for h in run)
                    features += len(run)
                rows.append((len(words), features, weight, weight + noise(doc_id, seed)))
            numbers = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * 4)]
            yield pa.RecordBatch.from_arrays(batch.columns[:kept] + numbers, [f.name for f in fields])

    doc_id, text = fresh_names(docs.columns, "doc_id", "text")
    given = docs.select(*keep, F.col("doc_id").cast("long").alias(doc_id), F.col("text").cast("string").alias(text))
    return given.mapInArrow(score, T.StructType(fields))


def _in_order(eligible: DataFrame, score: str, row: str, place: str) -> tuple[DataFrame, int]:
    """The rows sorted over partitions with their ranks as column ``place``, and their number.

    Before the ranks, ``place`` is the row's partition (high bits) and its place there, fixed by storing it.
    """
    order = [F.col(score).desc(), F.col("doc_id").asc_nulls_last(), F.col(row).asc()]
    ranged = stored(eligible.repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumn(place, F.monotonically_increasing_id()), "ranked")
    part = F.shiftright(F.col(place), 33)
    # One row for each partition of the sort.
    sizes = ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    offsets = stored(sizes, "offsets")
    n = offsets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rank = F.col("before") + F.col(place).bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranked = ranged.join(F.broadcast(offsets.select("part", "before")), part == F.col("part"))
    return ranked.withColumn(place, rank).drop("part", "before"), int(n)


def _scored_and_ranked(docs: DataFrame, target: DataFrame, keep: list[str], runs: int, buckets: int, seed: int,
                       percent: int, min_words: int) -> tuple[DataFrame, DataFrame, list[str], int]:
    """The stored scores, the eligible rows in order with their ranks, the new columns' names, rows to draw."""
    names = fresh_names(docs.columns, "n_words", "n_features", "weight", "score", "row", "rank")
    gains = bucket_gains(corpus_counts(docs, runs, buckets), corpus_counts(target, runs, buckets))
    score, row, rank = names[3:]
    every = stored(scored(docs, gains, keep, names[:4], runs, seed)
                   .withColumn(row, F.monotonically_increasing_id()), "scored")
    light = every.where(F.col(names[0]) >= min_words).select(*dict.fromkeys(["doc_id", *names[:5]]))
    ranked, n = _in_order(light, score, row, rank)
    return every, ranked, names, n * percent // 100


def importance_report(docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED,
                      percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, rank (null if it is not drawn)."""
    every, ranked, names, k = _scored_and_ranked(docs.select("doc_id", "text"), target.select("text"), ["doc_id"],
                                                 runs, buckets, seed, percent, min_words)
    words, features, weight, score, _, rank = names
    drawn = ranked.select("doc_id", features, weight, score, F.when(F.col(rank) <= k, F.col(rank)).alias("rank"))
    short = every.where(F.col(words) < min_words).select("doc_id", features, weight, score,
                                                         F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(short).select(F.col("doc_id").cast("long").alias("doc_id"),
                                           F.col(features).alias("n_features"), F.col(weight).alias("weight"),
                                           F.col(score).alias("score"), "rank")


def resampled(docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED,
              percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """The rows of ``docs`` that are drawn, columns as in ``docs``.

    The order's last drawn row is one row of numbers; the stored rows are compared with it.
    """
    every, ranked, names, k = _scored_and_ranked(docs, target.select("text"), docs.columns, runs, buckets, seed,
                                                 percent, min_words)
    words, _, _, score, row, rank = names
    last = ranked.where(F.col(rank) == k).select(score, "doc_id", row).first()
    if last is None:
        return every.limit(0).select(*docs.columns)
    best, doc_id, at = last
    tied = F.col("doc_id").eqNullSafe(F.lit(doc_id)) & (F.col(row) <= at)
    if doc_id is None:
        tied = tied | F.col("doc_id").isNotNull()
    else:
        tied = tied | (F.col("doc_id") < F.lit(doc_id))
    taken = (F.col(score) > best) | ((F.col(score) == best) & F.coalesce(tied, F.lit(False)))
    return every.where((F.col(words) >= min_words) & taken).select(*docs.columns)


def oracle_sql(seed: int = SEED, buckets: int = BUCKETS, percent: int = PERCENT, min_words: int = MIN_WORDS) -> str:
    """DuckDB SQL of ``importance_report`` with single words as features; crc32 byte by byte over its table."""
    # The reflected polynomial of crc32; eight steps make a table entry.
    step = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = "i AS c"
    for _ in range(8):
        table = f"{step} AS c FROM (SELECT i, {table}"
    table = f"SELECT i, {table} FROM range(256) r(i)" + ")" * 8
    return f"""
WITH t AS MATERIALIZED (SELECT list(c ORDER BY i) AS entries FROM ({table})),
texts AS (SELECT 0 AS side, doc_id, row_number() OVER () AS row, text FROM documents
  UNION ALL SELECT 1, NULL, row_number() OVER (), text FROM benchmark),
words AS MATERIALIZED (SELECT side, row, unnest(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM texts),
buckets AS MATERIALIZED (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
    range(octet_length(encode(word))), lambda i: ('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, entries[xor(c & 255, b) + 1])), 4294967295) % {buckets} AS bucket
  FROM (SELECT DISTINCT word FROM words), t),
counts AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t
  FROM words JOIN buckets USING (word) GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s_all, coalesce(sum(t), 0)::DOUBLE AS t_all FROM counts),
gains AS (SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + {buckets})) / ((s + 1) * (t_all + {buckets}))))::BIGINT
  AS gain FROM counts, sums),
weights AS (SELECT row, count(*) AS n, sum(gain)::BIGINT AS weight
  FROM words JOIN buckets USING (word) JOIN gains USING (bucket) WHERE side = 0 GROUP BY row),
hashed AS (SELECT doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    ('0x' || substr(sha256('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM texts LEFT JOIN weights USING (row) WHERE side = 0),
scored AS (SELECT doc_id, n_features, weight,
    weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM hashed),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n
  FROM scored WHERE n_features >= {min_words})
SELECT doc_id, n_features, weight, score, CASE WHEN r <= n * {percent} // 100 THEN r END AS rank FROM ranked
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_features < {min_words}"""
