"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each reads the driver tables through the fixture views and runs one
operator (or one job) over the whole tables.  Doubles are rounded to 6
places to match the DuckDB oracle in ``sigwin.plans.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigwin import schemas as S
from sigwin.functions.columns import contig_key, ensemble_mean, predicted_class, round_doubles, softmax2
from sigwin.operators import clean as C
from sigwin.operators import features as FE
from sigwin.operators import labels as L
from sigwin.operators import metrics as M
from sigwin.operators import models as ML
from sigwin.operators import ordering as O
from sigwin.operators import windows as W
from sigwin.operators.counts import RowCounts
from sigwin.operators.forest import node_table, walked_probability
from sigwin.plans import jobs as J
from sigwin.session import scratch_path, stored
from sigwin.sources import fixtures as FX
from sigwin.sources import sinks, tsv
from sigwin.sources.clustered import read_clustered_sites, write_clustered_sites
from sigwin.sources.profile import profile_scores

Query = Callable[[SparkSession, str], DataFrame]


def _events(spark, sf):
    return FX.event_table(spark, sf)


def _sites(spark, sf):
    return stored(C.clean_events(_events(spark, sf)), "sites")


def _windows(spark, sf):
    return W.context_windows(_sites(spark, sf))


def _wide_cols(df: DataFrame, extra=()) -> DataFrame:
    return round_doubles(df.select("contig", "position", *[F.col(S.q(c)) for c in S.FEATURES],
                                   *extra))


def _m6a(spark, sf):
    return J.m6a_training_set(_sites(spark, sf), FX.site_reference(spark, sf))


def _structure(spark, sf):
    return J.structure_training_set(_sites(spark, sf), FX.profile_long(spark, sf))


def q_event_scan(spark, sf):
    return round_doubles(tsv.events_from_frame(_events(spark, sf)))


def q_site_reference(spark, sf):
    return FX.site_reference(spark, sf)


def q_profile_dedup(spark, sf):
    return profile_scores(FX.profile_fields(spark, sf))


def q_clean_events(spark, sf):
    return round_doubles(C.clean_events(_events(spark, sf)))


def q_clipped_mean(spark, sf):
    return round_doubles(C.clipped_mean(_events(spark, sf)))


def q_group_median(spark, sf):
    return round_doubles(C.group_median(_events(spark, sf)))


def q_kmer_mode(spark, sf):
    return C.kmer_mode(_events(spark, sf))


def q_first_model_stdv(spark, sf):
    return round_doubles(C.first_model_stdv(_events(spark, sf)))


def q_relative_diff(spark, sf):
    return round_doubles(C.clean_events_with_model(_events(spark, sf)))


def q_contig_key(spark, sf):
    return _events(spark, sf).select("contig").distinct().select(
        "contig", contig_key("contig").alias("tx"))


def q_context_centres(spark, sf):
    return W.context_centres(_sites(spark, sf))


def q_windows_long(spark, sf):
    return round_doubles(W.windows_long(_sites(spark, sf)))


def q_windows_wide(spark, sf):
    return _wide_cols(W.windows_wide(_sites(spark, sf)))


def q_motif_windows(spark, sf):
    return _wide_cols(W.motif_filter(_windows(spark, sf)))


def q_finite_windows(spark, sf):
    return _wide_cols(W.finite_filter(W.drop_kmer_columns(_windows(spark, sf))))


def _m6a_windows(spark, sf):
    return W.finite_filter(W.drop_kmer_columns(W.motif_filter(_windows(spark, sf))))


def q_m6a_positive(spark, sf):
    return _wide_cols(L.sites_positive(_m6a_windows(spark, sf), FX.site_reference(spark, sf)))


def q_m6a_negative(spark, sf):
    return _wide_cols(L.sites_negative(_m6a_windows(spark, sf), FX.site_reference(spark, sf)))


def q_m6a_labels(spark, sf):
    return L.label_by_sites(_m6a_windows(spark, sf), FX.site_reference(spark, sf)).select(
        "contig", "position", "label")


def q_union_classes(spark, sf):
    w = stored(_m6a_windows(spark, sf), "windows")
    ref = FX.site_reference(spark, sf)
    return L.union_classes(L.sites_positive(w, ref), L.sites_negative(w, ref)).select(
        "contig", "position", "label")


def q_m6a_train(spark, sf):
    return _wide_cols(_m6a(spark, sf), ["label"])


def q_seeded_shuffle(spark, sf):
    return _m6a(spark, sf).select("contig", "position", "label", O.KEY)


def q_sample_negatives(spark, sf):
    m = J.m6a_training_set(_sites(spark, sf), FX.site_reference(spark, sf), shuffled=False)
    m = stored(m, "windows")
    n_pos = m.where(F.col("label") == 1).count()
    return O.sample_n(m.where(F.col("label") == 0), n_pos).select("contig", "position", O.KEY)


def _finite(spark, sf):
    return W.finite_filter(W.windows_wide(_sites(spark, sf)))


def q_profile_lookup(spark, sf):
    return L.profile_lookup(_finite(spark, sf), FX.profile_long(spark, sf)).select(
        "contig", "position", "score")


def q_reactivity_filter(spark, sf):
    return L.reactivity_filter(q_profile_lookup(spark, sf))


def q_structure_train(spark, sf):
    return _wide_cols(_structure(spark, sf), ["label"])


def q_infer_structure(spark, sf):
    structure, _ = J.inference_sets(_sites(spark, sf))
    return _wide_cols(structure, ["label"])


def q_infer_m6a(spark, sf):
    _, m6a = J.inference_sets(_sites(spark, sf))
    return _wide_cols(m6a, ["label"])


def q_class_weights(spark, sf):
    return round_doubles(FE.class_weights(_structure(spark, sf)))


def q_scaler_stats(spark, sf):
    return round_doubles(FE.scaler_stats(_structure(spark, sf)))


def q_scaled_features(spark, sf):
    st = stored(_structure(spark, sf), "windows")
    scaled = FE.scale_with_stats(st, FE.scaler_stats(st), keep=["contig", "position", "label"])
    return round_doubles(scaled)


def q_exact_split(spark, sf):
    return O.exact_split(_structure(spark, sf)).select("contig", "position", "split")


def q_tied_split(spark, sf):
    """Rows of each part when only the contig is the key: a few keys, each shared by many rows."""
    split = O.exact_split(_finite(spark, sf).select("contig", "position"), 0.3, key_cols=("contig",))
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def q_row_accounting(spark, sf):
    """Counts observed by the jobs as they write: cleaning, both training sets."""
    rows, m6a, st = RowCounts(), RowCounts(), RowCounts()
    sites = stored(rows.watch(J.clean(_events(spark, sf), rows), sites=J.EVERY), "sites")
    stored(J.m6a_training_set(sites, FX.site_reference(spark, sf), shuffled=False, rows=m6a), "m6a-set")
    stored(J.structure_training_set(sites, FX.profile_long(spark, sf), rows=st), "structure-set")
    r, m, s = rows.values(), m6a.values(), st.values()
    return spark.createDataFrame([
        ("events", r["events"]), ("sites", r["sites"]), ("windows", m["windows"]),
        ("motif_windows", m["windows"] - m["without_motif"]),
        ("finite_windows", s["windows"] - s["not_finite"]),
        ("m6a_windows", m["label_0"] + m["label_1"]), ("m6a_positive", m["label_1"]), ("m6a_negative", m["label_0"]),
        ("structure_0", s["label_0"]), ("structure_1", s["label_1"])], "item string, n long")


def q_site_index(spark, sf):
    """The bitmap index of the known sites: bits set in each bucket."""
    return L.site_index(FX.site_reference(spark, sf)).select("tx", "bucket", F.bitmap_count("bits").alias("sites"))


def q_profile_pieces(spark, sf):
    """The pieces that windows look their scores up in."""
    return L.profile_pieces(profile_scores(FX.profile_fields(spark, sf))).select(
        "tx", "bucket", F.size("scores").alias("scores"))


# Through files: written and read back by the library's own sinks and sources.
def q_site_file(spark, sf):
    path = scratch_path(spark, "site-file")
    sinks.write_sites(C.clean_events(_events(spark, sf)), path)
    return round_doubles(tsv.read_sites(spark, path))


def q_clustered_windows(spark, sf):
    """Windows over a stored clustered site table: no exchange behind the reading of it."""
    path = scratch_path(spark, "clustered-sites")
    write_clustered_sites(C.clean_events(_events(spark, sf)), path, files=16)
    return _wide_cols(W.windows_wide(read_clustered_sites(spark, path)))


def q_training_file(spark, sf):
    path = scratch_path(spark, "training-file")
    sinks.write_training_windows(_m6a(spark, sf), path, shuffle_col=O.KEY)
    back = tsv.read_windows(spark, path)
    tsv.check_window_columns(back)
    return _wide_cols(back, ["label"])


def q_inference_files(spark, sf):
    path = scratch_path(spark, "inference-files")
    paths = sinks.write_inference_sets(J.inference_windows(_sites(spark, sf)), path)
    sets = [tsv.read_windows(spark, p).select("contig", "position", "label", F.lit(name).alias("set"))
            for name, p in paths.items()]
    return sets[0].unionByName(sets[1])


def _scored(spark, sf):
    return FX.scored_docs(spark, sf)


def q_softmax2(spark, sf):
    return round_doubles(FX.document_scores(spark, sf).select("doc_id", softmax2("z0", "z1").alias("p1")))


def q_ensemble_mean(spark, sf):
    d = FX.document_scores(spark, sf).select("doc_id", softmax2("z0", "z1").alias("p_a"),
                                  softmax2("z0", "z1b").alias("p_b"))
    return round_doubles(d.select("doc_id", "p_a", "p_b", ensemble_mean("p_a", "p_b").alias("p_mean")))


def q_focal_loss(spark, sf):
    d = M.focal_loss(_scored(spark, sf), reduction="none")
    return round_doubles(d.agg(F.avg("loss").alias("loss_mean"), F.sum("loss").alias("loss_sum"),
                               F.count(F.lit(1)).alias("n")))


def q_roc_auc(spark, sf):
    return round_doubles(M.roc_auc(_scored(spark, sf)))


def q_average_precision(spark, sf):
    return round_doubles(M.average_precision(_scored(spark, sf)))


def q_pr_curve(spark, sf):
    return round_doubles(M.pr_curve(_scored(spark, sf)))


def q_metric_report(spark, sf):
    d = O.exact_split(_scored(spark, sf), 0.2, key_cols=("doc_id",))
    return round_doubles(M.metric_report(d, "split"))


def q_predicted_class(spark, sf):
    return FX.document_scores(spark, sf).select(
        "doc_id", predicted_class("z0", "z1").alias("p_a"), predicted_class("z0", "z1b").alias("p_b"))


# Model queries: fits have no SQL oracle, but their keys, ranges, counts and scoring do.
def _fitted(spark, sf):
    """The finite windows without labels, and the ensemble fitted on the structure set: both from one site table."""
    sites = _sites(spark, sf)
    training = stored(J.structure_training_set(sites, FX.profile_long(spark, sf)), "windows")
    return J.inference_sets(sites)[0], ML.fit_ensemble(training)


def q_ensemble_predict(spark, sf):
    return J.predict(*_fitted(spark, sf))


def q_forest_score(spark, sf):
    return q_ensemble_predict(spark, sf).select("contig", "position", "RandomForest_Prob")


def q_mlp_score(spark, sf):
    return q_ensemble_predict(spark, sf).select("contig", "position", "NeuralNetwork_Prob")


def q_predict_check(spark, sf):
    """Every finite window once, its probabilities within 0 and 1, the combined one their mean."""
    nn, rf, both = (F.col(c) for c in S.PREDICTION_COLUMNS[2:])
    return q_ensemble_predict(spark, sf).select(
        "contig", "position", (nn.between(0, 1) & rf.between(0, 1)).alias("in_range"),
        (F.abs(both - (nn + rf) / 2) < 1e-12).alias("is_mean"))


def q_forest_check(spark, sf):
    """Every finite window once: is its forest score what a walk down the node table gives, and is no
    node of fewer than ``min_split`` rows split?"""
    structure, fitted = _fitted(spark, sf)
    nodes = stored(node_table(spark, fitted.forest), "nodes")
    small = nodes.where((F.col("left") >= 0) & (F.col("n") < fitted.params.min_split)).count()
    arrays = ML.scaled_arrays(structure, fitted, ["contig", "position"])
    walked = walked_probability(arrays, nodes, "x", fitted.params.max_depth, "walked")
    scored = fitted.forest.transform(walked.withColumn("features", array_to_vector("x")))
    return scored.select("contig", "position",
                         (F.abs(F.col("walked") - F.get(vector_to_array("rf_prob"), F.lit(1))) < 1e-9).alias("same"),
                         F.lit(small == 0).alias("min_split_holds"))


def q_model_file(spark, sf):
    """Every finite window once: does the fitted state, saved and loaded, score as before?"""
    structure, fitted = _fitted(spark, sf)
    structure, path = stored(structure, "windows"), scratch_path(spark, "model-file")
    fitted.save(path)
    out = f"{path}-predictions"
    # The sort of the sink reads its input twice: the scores are stored.
    scored = stored(J.predict(structure, ML.FittedEnsemble.load(spark, path)), "scored")
    sinks.write_predictions(scored, out)
    again = spark.read.option("sep", "\t").option("header", True).csv(out).select(
        "contig", F.col("position").cast("long"), F.col("Combined_Prob").cast("double").alias("again"))
    both = J.predict(structure, fitted).join(again, ["contig", "position"], "full")
    return both.select("contig", "position", (F.abs(F.col("again") - F.col("Combined_Prob")) < 1e-9).alias("same"))


def q_fit_counts(spark, sf):
    """The rows that the report counts, by split and model."""
    return q_fit_report(spark, sf).select("split", "model", "n")


def q_fit_report(spark, sf):
    _, report = J.fit(_structure(spark, sf))
    return report


def q_fit_history(spark, sf):
    """Rows and metrics of both splits for each round of the network's training."""
    fitted, _ = J.fit(_structure(spark, sf))
    return ML.training_history(spark, fitted)


def q_history_check(spark, sf):
    """The rows of both splits in the first round; whether the best training loss is below the first."""
    history = stored(q_fit_history(spark, sf), "history")
    return history.groupBy("split").agg(
        F.max(F.when(F.col("round") == 0, F.col("n"))).alias("n"),
        ((F.min("loss") < F.max(F.when(F.col("round") == 0, F.col("loss")))) | (F.col("split") == "valid")).alias("learns"))


QUERIES: dict[str, Query] = {
    name[2:]: fn for name, fn in sorted(globals().items())
    if name.startswith("q_") and callable(fn)
}

ROWS_ONLY = {"ensemble_predict", "forest_score", "mlp_score", "fit_report", "fit_history"}
