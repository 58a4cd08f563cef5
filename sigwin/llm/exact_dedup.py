"""Operator 9: exact dedup by two-pass Bloom filtering (DataFrame functions only).

Digests are made once and stored with a row number.  Pass 1 sets, for each row, two bits
of one block of a counting Bloom filter and keeps the bits that were set more than once,
as one bitmap per block; what shuffles is a block number and two positions a row, and no
digest.  Pass 2 looks every row up: if a bit of it was set only once, no other row has
its text and it passes straight through.  Only the others shuffle, are grouped by digest
and get their group's result.  A false positive costs a shuffled row and nothing else.
The filter grows with the rows; it is broadcast while its bytes allow, and beyond that
rows meet its bitmaps by block number.

Texts are equal when they are after lower-casing A-Z.  The row with the largest
doc_id stays.  Defined results: a null text is the empty text; a null doc_id is
smaller than any other; of rows that share text and largest doc_id one stays;
an empty table gives no rows; other columns, whatever their names, are not read by
``dedup_report`` and are returned as they are by ``deduplicated``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigwin.llm.common import ascii_lower, broadcast_if_small, fresh_names, stored, text_or_empty
from sigwin.session import broadcast_bytes

#: Bits of a block, fixed by bitmap_construct_agg, and bits of the filter for each row.
BLOCK = 4096 * 8
BITS_PER_ROW = 16


def digest(text: Column) -> Column:
    return F.sha2(ascii_lower(text), 256)


def _positions(sha: Column) -> list[Column]:
    """Two bits within the row's block."""
    return [F.pmod(F.xxhash64(sha, F.lit(seed)), F.lit(BLOCK)).cast("int") for seed in (1, 2)]


def _block(sha: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(blocks))


def repeated_bits(keys: DataFrame, blocks: int) -> DataFrame:
    """``(block, bits)``: bits that two or more rows of ``keys`` set.  At most ``blocks`` rows of 4 KiB."""
    sha = F.col("sha")
    rows = keys.select(_block(sha, blocks).alias("block"), F.array_distinct(F.array(*_positions(sha))).alias("at"))
    # One short row a document travels; its bits are told apart where its block is.
    counted = (rows.repartition("block").select("block", F.explode("at").alias("at")).groupBy("block", "at")
               .agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return counted.groupBy("block").agg(F.bitmap_construct_agg(F.col("at").cast("long")).alias("bits"))


def _bit(bits: Column, at: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, at % 8) == 1


@dataclass(frozen=True)
class Filter:
    """The stored bitmaps of pass 1 and the number of blocks they are dealt into."""

    bits: DataFrame
    blocks: int

    def look_up(self, rows: DataFrame, sha: str, maybe: str) -> DataFrame:
        """``rows`` with ``maybe``: whether their digest in column ``sha`` is possibly repeated."""
        block, held = fresh_names([*rows.columns, maybe], "block", "bits")
        bits = self.bits.select(F.col("block").alias(block), F.col("bits").alias(held))
        if self.blocks * (BLOCK // 8) <= broadcast_bytes(rows.sparkSession):
            bits = F.broadcast(bits)
        both = F.lit(True)
        for at in _positions(F.col(sha)):
            both = both & _bit(F.col(held), at)
        return (rows.withColumn(block, _block(F.col(sha), self.blocks)).join(bits, block, "left")
                .withColumn(maybe, F.coalesce(both, F.lit(False))).drop(block, held))


def bloom_filter(keys: DataFrame) -> Filter:
    """Pass 1 over stored digests."""
    blocks = max(1, -(-keys.count() * BITS_PER_ROW // BLOCK))
    return Filter(stored(repeated_bits(keys, blocks), "bloom"), blocks)


def _keys(docs: DataFrame) -> DataFrame:
    """Stored ``(doc_id, sha, row)``: a rerun of a lost task reads the same numbers again."""
    return stored(docs.select("doc_id", digest(text_or_empty()).alias("sha"))
                  .withColumn("row", F.monotonically_increasing_id()), "digests")


def _groups(repeated: DataFrame) -> DataFrame:
    """``(key, best, best_row, n)`` for each digest: the doc_id and the row that stay."""
    best = F.max(F.struct("doc_id", "row"))
    return (repeated.groupBy(F.col("sha").alias("key")).agg(best.alias("best"), F.count(F.lit(1)).alias("n"))
            .select("key", F.col("best.doc_id").alias("best"), F.col("best.row").alias("best_row"), "n"))


def dedup_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keys = _keys(docs)
    looked_up = bloom_filter(keys).look_up(keys, "sha", "maybe")
    alone = looked_up.where("NOT maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    repeated = looked_up.where("maybe").drop("maybe")
    # One row per digest on the other side, so a hot digest's rows can be split (AQE skew join).
    grouped = repeated.join(_groups(repeated), F.col("sha") == F.col("key")).select(
        "doc_id", F.col("best").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("row") == F.col("best_row")).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.unionByName(grouped)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, columns as in ``docs``.

    No row numbers: a row is known by digest and doc_id, which are the same at every
    read of ``docs``, so a group always keeps a row.  Digests find the groups first; then
    the documents are read again, and those that are possibly repeated meet their group.
    Only rows that share digest and largest doc_id (repeated rows) meet each other, and
    one of them is taken.
    """
    keys = _keys(docs)
    bloom = bloom_filter(keys)
    repeated = bloom.look_up(keys, "sha", "maybe").where("maybe")
    best = F.max(F.struct("doc_id", "n"))
    groups = (repeated.groupBy("sha", "doc_id").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("sha").agg(best.alias("best"), F.sum("n").alias("all")).where("all > 1"))
    sha, maybe, key, stays, times = fresh_names(docs.columns, "sha", "maybe", "key", "stays", "times")
    groups = broadcast_if_small(stored(groups.select(
        F.col("sha").alias(key), F.col("best.doc_id").alias(stays), F.col("best.n").alias(times)), "groups"), 128)
    rows = bloom.look_up(docs.withColumn(sha, digest(text_or_empty())), sha, maybe)
    held = rows.where(F.col(maybe)).join(groups, F.col(sha) == F.col(key), "left")
    alone = F.col(key).isNull() | (F.col("doc_id").eqNullSafe(F.col(stays)) & (F.col(times) == 1))
    several = held.where(F.col("doc_id").eqNullSafe(F.col(stays)) & (F.col(times) > 1)).dropDuplicates([key])
    parts = [rows.where(~F.col(maybe)), held.where(alone), several]
    return reduce(DataFrame.unionByName, [p.select(*docs.columns) for p in parts])


ORACLE = """
WITH n AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)"""
