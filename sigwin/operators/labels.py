"""Labelling of windows: known sites (m6A) and reactivity profiles (structure),
plus the constant label of inference sets.

Known sites are an index of bitmaps: for each transcript one bitmap per 32,768
positions, made by the built-in bitmap aggregates.  A window joins the bitmap of its
bucket and tests one bit, so the joined side has a row per bucket and not per site, and
duplicate sites are one bit.  Profiles are pieces of 4,096 scores, joined the same way; a
piece is a map of maps of 64 scores, since Spark searches a map entry by entry.
Both sides are broadcast if their bytes allow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigwin.functions.columns import binarise, bit_is_set, contig_key
from sigwin.operators.joins import broadcast_if_small

SITE_OFFSET = 1   # event positions are 0-based, reference sites 1-based
INFERENCE_LABEL = -1
#: Bits of a bitmap, fixed by bitmap_construct_agg, and scores of a profile's piece.
BITMAP = 4096 * 8
PIECE = 4096
#: Scores of a part of a piece: a map is searched entry by entry.
PART = 64


def _bucket(position, size: int):
    return F.floor(position / F.lit(size)).cast("long")


def site_index(ref: DataFrame) -> DataFrame:
    """``(tx, bucket, bits)``: the known 1-based positions of a transcript as bitmaps."""
    sites = ref.select("tx", F.col("pos1").cast("long").alias("pos1")).where(
        F.col("tx").isNotNull() & F.col("pos1").isNotNull())
    return (sites.groupBy("tx", _bucket(F.col("pos1"), BITMAP).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.pmod(F.col("pos1"), F.lit(BITMAP))).alias("bits")))


def with_known_site(windows: DataFrame, ref: DataFrame, name: str = "_known",
                    max_bytes: int | None = None) -> DataFrame:
    """``windows`` with a boolean: is (transcript id, centre + 1) a known site?  A contig without an id is not."""
    index = broadcast_if_small(site_index(ref).select(
        F.col("tx").alias("_tx"), F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits")), max_bytes, "site-index")
    pos1 = F.col("position") + SITE_OFFSET
    hit = F.coalesce(bit_is_set(F.col("_bits"), F.pmod(pos1, F.lit(BITMAP))), F.lit(False))
    return (windows.withColumn("_tx", contig_key("contig")).withColumn("_bucket", _bucket(pos1, BITMAP))
            .join(index, ["_tx", "_bucket"], "left").withColumn(name, hit).drop("_tx", "_bucket", "_bits"))


def sites_positive(windows: DataFrame, ref: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Windows whose (transcript id, centre + 1) is a known site."""
    return with_known_site(windows, ref, max_bytes=max_bytes).where("_known").drop("_known")


def sites_negative(windows: DataFrame, ref: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """All other windows; a contig without an id is negative."""
    return with_known_site(windows, ref, max_bytes=max_bytes).where("NOT _known").drop("_known")


def label_by_sites(windows: DataFrame, ref: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Both classes in one pass: label 1 for known sites, else 0."""
    return (with_known_site(windows, ref, max_bytes=max_bytes)
            .withColumn("label", F.col("_known").cast(T.IntegerType())).drop("_known"))


def union_classes(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """Positive rows labelled 1 and negative rows labelled 0, stacked."""
    return (positive.withColumn("label", F.lit(1).cast(T.IntegerType()))
            .unionByName(negative.withColumn("label", F.lit(0).cast(T.IntegerType()))))


def _placed_scores(profile_long: DataFrame, size: int) -> DataFrame:
    """``(tx, bucket, at, score)``: one score a position; at most ``size`` of them meet in a bucket."""
    return profile_long.where(F.col("tx").isNotNull() & F.col("pos").isNotNull()).groupBy(
        "tx", _bucket(F.col("pos"), size).alias("bucket"), F.pmod(F.col("pos"), F.lit(size)).cast("int").alias("at")
    ).agg(F.min("score").alias("score"))


def profile_pieces(profile_long: DataFrame, size: int = PIECE) -> DataFrame:
    """``(tx, bucket, scores)``: a map of position in the bucket to score for every ``size`` positions."""
    return (_placed_scores(profile_long, size).groupBy("tx", "bucket")
            .agg(F.map_from_entries(F.collect_list(F.struct("at", "score"))).alias("scores")))


def lookup_pieces(profile_long: DataFrame, size: int = PIECE, part: int = PART) -> DataFrame:
    """``(tx, bucket, parts)``: the pieces as maps of part number to a map of place in the part to score."""
    at = F.col("at")
    placed = _placed_scores(profile_long, size).select(
        "tx", "bucket", F.floor(at / F.lit(part)).cast("int").alias("part"),
        F.struct((at % part).alias("at"), "score").alias("entry"))
    parts = placed.groupBy("tx", "bucket", "part").agg(F.map_from_entries(F.collect_list("entry")).alias("scores"))
    return parts.groupBy("tx", "bucket").agg(
        F.map_from_entries(F.collect_list(F.struct("part", "scores"))).alias("parts"))


def profile_lookup(windows: DataFrame, profile_long: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """Attach the profile score (text) at the window centre: equi join on (transcript id, bucket)
    against the profile's pieces and a look-up there; a window with no score keeps a NULL (left join)."""
    pieces = lookup_pieces(profile_long).select(F.col("tx").alias("_tx"), F.col("bucket").alias("_bucket"),
                                                F.col("parts").alias("_parts"))
    pieces = broadcast_if_small(pieces, max_bytes, "profile-pieces")
    at = F.pmod(F.col("position"), F.lit(PIECE)).cast("int")
    scores = F.try_element_at("_parts", F.floor(at / F.lit(PART)).cast("int"))
    score = F.try_element_at(scores, at % PART)
    return (windows.withColumn("_tx", contig_key("contig")).withColumn("_bucket", _bucket(F.col("position"), PIECE))
            .join(pieces, ["_tx", "_bucket"], "left").withColumn("score", score).drop("_tx", "_bucket", "_parts"))


def reactivity_filter(df: DataFrame, score_col: str = "score", lo: float = 0.2,
                      hi: float = 0.8) -> DataFrame:
    """Keep rows whose score parses and is <= lo or >= hi (NaN dropped,
    +/-inf kept)."""
    s = F.col(score_col).try_cast(T.DoubleType())
    return df.where(binarise(s, lo, hi).isNotNull())


def structure_label(df: DataFrame, score_col: str = "score", lo: float = 0.2,
                    hi: float = 0.8) -> DataFrame:
    """Reactivity filter + binarised label in place of the score."""
    s = F.col(score_col).try_cast(T.DoubleType())
    return (df.withColumn("label", binarise(s, lo, hi))
            .where(F.col("label").isNotNull()).drop(score_col))


def constant_label(df: DataFrame, value: int = INFERENCE_LABEL) -> DataFrame:
    return df.withColumn("label", F.lit(value).cast(T.IntegerType()))
