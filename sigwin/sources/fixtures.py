"""Fixture views built by Spark from the driver's tables.

The driver ships generic tables (``events``, ``documents``, ``labels`` ...).
These functions derive the reference's inputs from them, so every registered
query reads the given tables and its work grows with them:

* ``event_table``   -- signal events (T1) from ``events``
* ``site_reference``-- 1-based modification sites (T5) from the event table
* ``profile_long``  -- per-position reactivity scores, as text
* ``profile_fields`` -- the same as the fields of a ragged profile file (T6), with a
  duplicate line and a short line so the dedup rule is exercised
* ``scored_docs``   -- truth + scores for the ranking metrics

The identical definitions in DuckDB SQL live in ``sigwin.plans.oracle``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigwin.functions.columns import contig_key
from sigwin.operators.labels import PIECE, profile_pieces

#: Splits of the second line of the first transcript's file come after those of the first.
SECOND = 1 << 40

# Fixed values of the fixture: the k-mer source pattern and the event types
# mapped to contig numbers (anything else shares contig 5).
KMER_PATTERN = "GGACTAGACATTGACCA"
EVENT_TYPE_IDS = [("click", 1), ("error", 2), ("purchase", 3), ("signup", 4)]

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _cid(event_type: Column) -> Column:
    expr = F.when(F.lit(False), F.lit(0))
    for name, i in EVENT_TYPE_IDS:
        expr = expr.when(event_type == name, F.lit(i))
    return expr.otherwise(F.lit(5))


def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal events: one row per driver event, keyed (contig, position).

    Every 41st position is absent (coverage holes; users are dealt around it, so no
    event is left out), ``event_length`` has NULLs,
    ``model_stdv`` has zeros and the values are heavy-tailed, so clipping,
    NULL handling and window gaps all occur.
    """
    e = read_table(spark, sf_dir, "events")
    cid = _cid(F.col("event_type"))
    k = F.pmod(cid + F.col("user_id"), F.lit(len(KMER_PATTERN)))
    eid = F.col("event_id")
    return (
        e.select(
            F.concat(F.lit("ENST"), F.lpad(cid.cast("string"), 11, "0"), F.lit(".1|"),
                     F.col("event_type")).alias("contig"),
            F.expr("CAST(user_id + user_id DIV 40 AS BIGINT)").alias("position"),
            F.substring(F.lit(KMER_PATTERN * 2), (k + 1).cast("int"), 5).alias("reference_kmer"),
            F.col("value").cast("double").alias("event_level_mean"),
            (F.col("value") / (F.lit(1) + F.pmod(eid, F.lit(7)))).alias("event_stdv"),
            F.when(F.pmod(eid, F.lit(101)) == 0, F.lit(None).cast("double"))
             .otherwise(F.pmod(eid, F.lit(1000)) / F.lit(100000.0)).alias("event_length"),
            F.when(F.pmod(eid, F.lit(97)) == 0, F.lit(0.0))
             .otherwise(F.lit(1.0) + F.pmod(eid, F.lit(5))).alias("model_stdv"),
            ((F.col("value") - F.lit(50.0)) / F.lit(49.0)).alias("standardized_level"),
            eid.cast("long").alias("ord"),
        )
    )


def site_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known modification sites (tx, 1-based pos1): every third position."""
    ea = event_table(spark, sf_dir)
    return (ea.where(F.pmod(F.col("position"), F.lit(3)) == 0)
            .select(contig_key("contig").alias("tx"), (F.col("position") + 1).alias("pos1"))
            .dropDuplicates())


def profile_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tx, pos, score text): score = (pos * 37 mod 101) / 100 as '%.2f', with
    'NULL' and 'nan' entries; contigs of event type 'view' have no profile."""
    ea = event_table(spark, sf_dir)
    p = F.col("position")
    score = (F.when(F.pmod(p, F.lit(13)) == 0, F.lit("NULL"))
             .when(F.pmod(p, F.lit(29)) == 0, F.lit("nan"))
             .otherwise(F.format_string("%.2f", F.pmod(p * 37, F.lit(101)) / F.lit(100.0))))
    return (ea.select("contig", "position").distinct()
            .where(~F.col("contig").like("%view"))
            .select(contig_key("contig").alias("tx"), p.alias("pos"), score.alias("score")))


def profile_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields ``(value, file, start, row)`` of profile files, as ``sources.profile`` reads them.

    One file a transcript, and one split for every 4,096 positions; gaps are 'NULL', so that
    a score's place is its position.  The last field of a line ends with a line break.  The
    first transcript's file has a second line (all '0.50'), whose id follows the break in the
    same field and which must lose to the first line; a file for the 'view' transcript has
    a short line, which leaves it without scores.
    """
    long = profile_long(spark, sf_dir)
    pieces = profile_pieces(long)
    last = long.groupBy("tx").agg(F.max("pos").alias("last"))
    bucket = F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("last") / F.lit(PIECE)).cast("long")))
    # At most PIECE positions a row, so no row holds a transcript.
    cut = last.select("tx", "last", bucket.alias("bucket")).join(pieces, ["tx", "bucket"], "left")
    places = F.sequence(F.lit(0), F.least(F.lit(PIECE - 1), (F.col("last") - F.col("bucket") * PIECE)).cast("int"))
    score = F.coalesce(F.try_element_at("scores", F.col("at")), F.lit("NULL"))
    scores = (cut.select("tx", "last", "bucket", "scores", F.explode(places).alias("at"))
              .select("tx", "last", "bucket", (F.col("bucket") * PIECE + F.col("at")).alias("pos"), score.alias("score")))
    first_tx = F.concat(F.lit("ENST"), F.lpad(F.lit("1"), 11, "0"), F.lit(".1"))
    ends = F.col("pos") == F.col("last")
    after = F.when(F.col("tx") == first_tx, F.concat(F.lit("\n"), F.col("tx"))).otherwise(F.lit("\n"))
    line = scores.select(F.when(ends, F.concat("score", after)).otherwise(F.col("score")).alias("value"),
                         F.col("tx").alias("file"), "bucket", (F.col("pos") + 3).alias("row"))
    lead = F.array(*[F.struct(F.lit(i).cast("long").alias("row"), v.alias("value")) for i, v in enumerate(
        (F.col("tx"), (F.col("last") + 1).cast("string"), F.lit("*")))])
    leads = last.select(F.col("tx").alias("file"), F.lit(0).cast("long").alias("bucket"), F.inline(lead))
    again = scores.where(F.col("tx") == first_tx)
    second = again.select(F.when(ends, F.lit("0.50\n")).otherwise(F.lit("0.50")).alias("value"),
                          F.col("tx").alias("file"), (F.col("bucket") + SECOND).alias("bucket"),
                          (F.col("last") + 6 + F.col("pos")).alias("row"))
    lead = F.array(*[F.struct((F.col("last") + 4 + i).alias("row"), v.alias("value")) for i, v in enumerate(
        ((F.col("last") + 1).cast("string"), F.lit("*")))])
    leads2 = last.where(F.col("tx") == first_tx).select(
        F.col("tx").alias("file"), F.lit(SECOND).cast("long").alias("bucket"), F.inline(lead))
    view = F.concat(F.lit("ENST"), F.lpad(F.lit("5"), 11, "0"), F.lit(".1"))
    short = F.array(*[F.struct(F.lit(i).cast("long").alias("row"), v.alias("value")) for i, v in enumerate(
        (F.col("tx"), F.lit("0\n")))])
    shorts = (event_table(spark, sf_dir).where(F.col("contig").like("%view")).select(contig_key("contig").alias("tx"))
              .distinct().where(F.col("tx") == view)
              .select(F.col("tx").alias("file"), F.lit(0).cast("long").alias("bucket"), F.inline(short)))
    names = ["value", "file", F.col("bucket").alias("start"), "row"]
    parts = [t.select(*names) for t in (line, leads, second, leads2, shorts)]
    return reduce(DataFrame.unionByName, parts)


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, two logits and a second model's logit of every document."""
    score = F.round(F.col("n_chars") / F.lit(500.0))
    return read_table(spark, sf_dir, "documents").select(
        "doc_id", score.alias("score"), F.lit(0.0).alias("z0"),
        (score / F.lit(4.0) - F.lit(2.0)).alias("z1"),
        (F.log(F.col("n_chars").cast("double") + F.lit(1.0)) - F.lit(7.0)).alias("z1b"))


def scored_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth and scores for the ranking metrics: documents x labels.

    label = quality, score = round(n_chars / 500) (ties on purpose), and two
    logits / probabilities derived from it for the loss and ensemble checks.
    """
    lab = read_table(spark, sf_dir, "labels")
    return (document_scores(spark, sf_dir).join(lab, "doc_id")
            .select("doc_id", F.col("quality").cast("int").alias("label"), "score", "z0", "z1", "z1b"))
