"""User-level jobs chaining the operators:

* ``clean``                  events -> site table
* ``m6a_training_set``       sites + known sites -> motif windows labelled 1/0, shuffled
* ``structure_training_set`` sites + profile -> windows labelled by reactivity
* ``inference_sets``         sites -> all windows and motif windows, label -1
* ``fit``                    labelled windows -> fitted ensemble + metric report
* ``predict``                windows + fitted ensemble -> prediction table
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigwin import schemas as S
from sigwin.functions.columns import is_drach
from sigwin.operators import clean as C
from sigwin.operators import labels as L
from sigwin.operators import metrics as M
from sigwin.operators import models as ML
from sigwin.operators import ordering as O
from sigwin.operators import windows as W
from sigwin.operators.counts import RowCounts, watch
from sigwin.session import stored
from sigwin.sources.tsv import SchemaError

#: The condition that holds for every row, for ``RowCounts``.
EVERY = True
#: The sets of the inference job: all windows, and those with the motif.
STRUCTURE, M6A = "structure", "m6a"


def clean(events: DataFrame, rows: RowCounts | None = None) -> DataFrame:
    keyed = F.col("contig").isNotNull() & F.col("position").isNotNull()
    return C.clean_events(watch(events, rows, events=EVERY, events_without_key=~keyed))


def _window_table(df: DataFrame, *extra: str) -> DataFrame:
    return df.select(*extra, *[F.col(S.q(c)) for c in S.WINDOW_COLUMNS])


def _counted_sites(sites: DataFrame, bucket: int, rows: RowCounts | None) -> DataFrame:
    """Each site counts once, also in a clustered table, which holds some twice."""
    staged = W.BUCKET_COL in sites.columns
    own = F.col(W.BUCKET_COL) == F.floor(F.col("position") / F.lit(bucket)) if staged else EVERY
    return watch(sites, rows, sites=own)


def _by_label(df: DataFrame, rows: RowCounts | None) -> DataFrame:
    return watch(df, rows, label_0=F.col("label") == 0, label_1=F.col("label") == 1)


def m6a_training_set(sites: DataFrame, reference: DataFrame, shuffled: bool = True,
                     bucket: int = W.DEFAULT_BUCKET, rows: RowCounts | None = None) -> DataFrame:
    """Windows -> DRACH filter -> site labels -> finite filter -> seeded
    shuffle key.  59 window columns (+ ``shuffle_key`` when shuffled)."""
    windows = W.context_windows(_counted_sites(sites, bucket, rows), bucket=bucket)
    motif = W.motif_filter(watch(windows, rows, windows=EVERY, without_motif=~is_drach(W.MOTIF_COL)))
    labelled = W.finite_filter(L.label_by_sites(W.drop_kmer_columns(motif), reference), rows=rows)
    out = _window_table(_by_label(labelled, rows))
    return O.with_shuffle_key(out) if shuffled else out


def structure_training_set(sites: DataFrame, profile_long: DataFrame,
                           bucket: int = W.DEFAULT_BUCKET, rows: RowCounts | None = None) -> DataFrame:
    """Windows (no motif filter) -> finite filter -> profile score at the
    centre -> reactivity cut -> 0/1 label."""
    windows = W.windows_wide(_counted_sites(sites, bucket, rows), bucket=bucket)
    scored = L.profile_lookup(W.finite_filter(watch(windows, rows, windows=EVERY), rows=rows), profile_long)
    scored = watch(scored, rows, without_score=F.col("score").isNull())
    return _window_table(_by_label(L.structure_label(scored), rows))


def inference_windows(sites: DataFrame, bucket: int = W.DEFAULT_BUCKET, rows: RowCounts | None = None) -> DataFrame:
    """The 59 window columns and ``set``: each finite window, labelled -1, once for every set it is in.

    One window pass gives both sets: a window with the motif is two rows.
    """
    windows = W.context_windows(_counted_sites(sites, bucket, rows), bucket=bucket)
    finite = W.finite_filter(watch(windows, rows, windows=EVERY), S.FEATURES, rows)
    sets = F.array_compact(F.array(F.lit(STRUCTURE), F.when(is_drach(W.MOTIF_COL), F.lit(M6A))))
    tagged = L.constant_label(finite.withColumn("set", F.explode(sets)))
    tagged = watch(tagged, rows, **{name: F.col("set") == name for name in (STRUCTURE, M6A)})
    return _window_table(tagged, "set")


def inference_sets(sites: DataFrame, bucket: int = W.DEFAULT_BUCKET) -> tuple[DataFrame, DataFrame]:
    """(all windows, DRACH windows), both finite and labelled -1."""
    tagged = inference_windows(sites, bucket)
    return tuple(tagged.where(F.col("set") == name).drop("set") for name in (STRUCTURE, M6A))


def scored_long(pred: DataFrame) -> DataFrame:
    """Predictions that carry split and label, one row per (model, window)."""
    models = F.array(
        F.struct(F.lit("NeuralNetwork").alias("model"), F.col("NeuralNetwork_Prob").alias("p")),
        F.struct(F.lit("RandomForest").alias("model"), F.col("RandomForest_Prob").alias("p")),
        F.struct(F.lit("Combined").alias("model"), F.col("Combined_Prob").alias("p")))
    long = pred.select("contig", "position", "split", "label", F.inline(models))
    z0, z1 = M.prob_to_logits("p")
    return long.select("*", z0.alias("z0"), z1.alias("z1"), F.col("p").alias("score"))


def fit(windows: DataFrame, params: ML.EnsembleParams | None = None):
    """Exact validation split -> fit on the train part -> score both parts ->
    (split, model, n, loss, auc, ap) report.  Returns (fitted, report)."""
    missing = [c for c in S.WINDOW_COLUMNS if c not in windows.columns]
    if missing:
        raise SchemaError(f"training windows lack columns: {missing}")
    params = params or ML.EnsembleParams()
    # The split reads stored rows: the models, the scaler and the report reuse them.
    split = O.exact_split(windows, params.valid_ratio, seed=params.seed).drop(O.KEY)
    fitted = ML.fit_ensemble(split, params=params)
    # Scores keep their row's split and label: no join back, which would repeat replicates.
    pred = ML.predict(split.withColumn("label", F.col("label").cast("int")), fitted,
                      keep=("contig", "position", "split", "label"))
    report = M.metric_report(scored_long(stored(pred, "scored")), ["split", "model"])
    return fitted, report


def predict(windows: DataFrame, fitted: ML.FittedEnsemble, rows: RowCounts | None = None) -> DataFrame:
    return ML.predict(windows, fitted, rows=rows)
