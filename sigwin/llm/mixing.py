"""Operator 5: mix sources to target weights.

Tokens are summed per source, each source gets a target by water filling, the
ratio of target to size is its repetition rate, and a document is emitted
``floor(rate)`` times plus once more with probability ``rate - floor(rate)``,
decided by a seeded hash of the document.

Defined results: a null text has size 0 and is taken 0 words; a null source is a
source of its own, last in order; repeated rows get the same draw (one row in,
one row out); a source without words has target 0; an empty table gives no rows;
columns of the input beyond the ones read, whatever their names, stay untouched in
``mixed_documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sigwin.llm.common import broadcast_if_small, fresh_names, stored, text_or_empty

SEED = 20240
MAX_RATE = 3.0
WEIGHTS = (1, 2, 3)


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters outside space, tab, LF, VT, FF and CR."""
    return F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_rate: float = MAX_RATE) -> DataFrame:
    """``(source, source_size, target, rate)`` from ``(source, size)`` rows.

    The targets solve ``target = min(max_rate * size, level * weight)`` with the
    targets adding up to all sizes; that is where giving the excess of capped
    sources to the others by weight ends.  Sources are capped in ascending order of
    ``size / weight``, so running sums over the one-row-per-source table find the level.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (k + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(max_rate))
    every = Window.partitionBy()
    fill = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    per = (
        per.withColumn("total", F.sum("source_size").over(every).cast("double"))
        # The level if exactly the sources before this one are capped.
        .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                    / F.sum("w").over(rest))
        # It rises up to the first source that is not capped and falls after it.
        .withColumn("target", F.least("cap", F.max("level").over(every) * F.col("w")))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return per.select("source", "source_size", "target", F.least(rate, F.lit(max_rate)).alias("rate"))


def copies(rate: Column, key: Column, seed: int = SEED) -> Column:
    """``floor(rate)`` plus one when the hash of ``key``, as a fraction of 1, is below the rest."""
    draw = F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
    whole = F.floor(rate)
    return (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("long")


def _mix(docs: DataFrame, names: list[str], **options) -> DataFrame:
    """``docs`` with size, size of its source, target of its source and copies, called ``names``."""
    size, source_size, target, times = names
    source, rate = fresh_names([*docs.columns, *names], "source", "rate")
    sized = docs.withColumn(size, word_count(text_or_empty()))
    targets = source_targets(sized.select("source", F.col(size).alias("size")), **options)
    targets = targets.select(F.col("source").alias(source), F.col("source_size").alias(source_size),
                             F.col("target").alias(target), F.col("rate").alias(rate))
    # One row per source: broadcast if its bytes allow; else a join in which hot sources are split.
    targets = broadcast_if_small(stored(targets, "targets"))
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col(source)), "left")
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64(text_or_empty()).cast("string"))
    return joined.withColumn(times, copies(F.col(rate), key)).drop(source, rate)


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken, copies."""
    names = ["size", "source_size", "target", "copies"]
    return _mix(docs.select("doc_id", "text", "source"), names, **options).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as it is taken, columns as in ``docs``."""
    *names, copy = fresh_names(docs.columns, "size", "source_size", "target", "copies", "copy")
    repeated = _mix(docs, names, **options).where(F.col(names[-1]) > 0)
    return (repeated.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(names[-1]).cast("int"))))
            .select(*docs.columns))
