"""File-to-file jobs: each reads its inputs, runs one job and writes the result.

    spark-submit sigwin_job.py clean EVENTS OUT
    spark-submit sigwin_job.py m6a-set SITES KNOWN_SITES OUT
    spark-submit sigwin_job.py structure-set SITES PROFILE OUT
    spark-submit sigwin_job.py inference-sets SITES PREFIX
    spark-submit sigwin_job.py fit WINDOWS OUT_FOLDER [--trees N --depth N ...]
    spark-submit sigwin_job.py predict WINDOWS MODEL_FOLDER OUT

Inputs are tab-separated files or folders of them; ``--format parquet`` changes what is
written, and ``clean --format clustered`` writes the site table in the layout that the
set jobs read without an exchange (``--sites clustered``).  ``fit`` writes ``model``, ``report``, ``history`` and ``rows`` into its folder.
Every job returns its row counts (read, skipped, dropped, kept) and ``main`` prints them;
they are observed by the jobs that do the work, without reading anything again.  Results
are stored in the shared folder before they are sorted into their files, as a sort reads
its input twice.  On a cluster ``spark.checkpoint.dir`` must be set.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sigwin.operators import models as ML
from sigwin.operators import ordering as O
from sigwin.operators import windows as W
from sigwin.operators.counts import RowCounts
from sigwin.plans import jobs as J
from sigwin.session import stored
from sigwin.sources import clustered, profile, sinks, tsv

LINES = ["lines_read", "lines_skipped", "lines_dropped"]


def clean_file(spark: SparkSession, events: str, out: str, fmt: str = "tsv") -> DataFrame:
    rows = RowCounts()
    sites = rows.watch(J.clean(tsv.read_events(spark, events), rows), sites=J.EVERY)
    if fmt == "clustered":
        clustered.write_clustered_sites(sites, out)
    else:
        sinks.write_sites(stored(sites, "sites"), out, fmt)
    return rows.table(spark)


def _sites(spark: SparkSession, path: str, layout: str) -> DataFrame:
    return clustered.read_clustered_sites(spark, path) if layout == "clustered" else tsv.read_sites(spark, path)


def m6a_set_file(spark: SparkSession, sites: str, known: str, out: str, fmt: str = "tsv", layout: str = "tsv") -> DataFrame:
    rows = RowCounts()
    windows = J.m6a_training_set(_sites(spark, sites, layout), tsv.read_site_reference(spark, known), rows=rows)
    sinks.write_training_windows(stored(windows, "m6a-set"), out, fmt, shuffle_col=O.KEY)
    return rows.table(spark)


def structure_set_file(spark: SparkSession, sites: str, path: str, out: str, fmt: str = "tsv", layout: str = "tsv") -> DataFrame:
    rows = RowCounts()
    windows = J.structure_training_set(_sites(spark, sites, layout), profile.read_profile(spark, path), rows=rows)
    sinks.write_training_windows(stored(windows, "structure-set"), out, fmt)
    return rows.table(spark)


def inference_sets_files(spark: SparkSession, sites: str, prefix: str, fmt: str = "tsv", layout: str = "tsv") -> DataFrame:
    """Writes ``PREFIX/set=structure`` and ``PREFIX/set=m6a`` by one job over one pass of windows."""
    rows = RowCounts()
    sinks.write_inference_sets(stored(J.inference_windows(_sites(spark, sites, layout), rows=rows), "inference"), prefix, fmt)
    return rows.table(spark)


def fit_file(spark: SparkSession, windows: str, out: str, params: ML.EnsembleParams | None = None) -> DataFrame:
    """Fits on a window file of exactly the 59 columns."""
    rows = RowCounts()
    df, lines = tsv.read_windows(spark, windows, with_accounting=True)
    tsv.check_window_columns(df)
    rows.add(lines, LINES)
    finite = W.finite_filter(rows.watch(df, windows=J.EVERY), rows=rows)
    finite = rows.watch(finite, label_0=F.col("label") == 0, label_1=F.col("label") == 1)
    fitted, report = J.fit(stored(finite, "windows"), params)
    fitted.save(f"{out}/model")
    for name, table in (("report", report), ("history", ML.training_history(spark, fitted)), ("rows", rows.table(spark))):
        sinks.write_tsv(table, f"{out}/{name}")
    return rows.table(spark)


def predict_file(spark: SparkSession, windows: str, model: str, out: str, fmt: str = "tsv") -> DataFrame:
    """Writes the predictions; returns the row counts of the windows."""
    rows = RowCounts()
    df, lines = tsv.read_windows(spark, windows, with_accounting=True)
    rows.add(lines, LINES)
    predicted = J.predict(df, ML.FittedEnsemble.load(spark, model), rows)
    sinks.write_predictions(stored(rows.watch(predicted, predictions=J.EVERY), "predictions"), out, fmt)
    return rows.table(spark)


JOBS = {
    "clean": (clean_file, ("events", "out")),
    "m6a-set": (m6a_set_file, ("sites", "known", "out")),
    "structure-set": (structure_set_file, ("sites", "path", "out")),
    "inference-sets": (inference_sets_files, ("sites", "prefix")),
    "fit": (fit_file, ("windows", "out")),
    "predict": (predict_file, ("windows", "model", "out")),
}


def _layers(text: str) -> list[int]:
    return [int(n) for n in text.split(",") if n]


#: Options of ``fit``: flag, field of the hyper-parameters, type.
FIT_OPTIONS = [
    ("--trees", "num_trees", int), ("--depth", "max_depth", int), ("--min-leaf", "min_instances_per_node", int),
    ("--min-split", "min_split", int), ("--layers", "hidden_layers", _layers), ("--rounds", "max_iter", int),
    ("--patience", "patience", int), ("--alpha", "alpha", float), ("--gamma", "gamma", float),
    ("--ratio", "valid_ratio", float), ("--seed", "seed", int),
]


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="sigwin_job")
    commands = parser.add_subparsers(dest="job", required=True)
    for name, (_, inputs) in JOBS.items():
        command = commands.add_parser(name)
        for path in inputs:
            command.add_argument(path)
        if name == "fit":
            for flag, fieldname, kind in FIT_OPTIONS:
                command.add_argument(flag, dest=fieldname, type=kind, default=argparse.SUPPRESS)
        else:
            formats = ("tsv", "parquet", "clustered") if name == "clean" else ("tsv", "parquet")
            command.add_argument("--format", dest="fmt", choices=formats, default="tsv")
        if "sites" in inputs:
            command.add_argument("--sites", dest="layout", choices=("tsv", "clustered"), default="tsv")
    given = vars(parser.parse_args(argv))
    job = given.pop("job")
    if job == "fit":
        names = [f for _, f, _ in FIT_OPTIONS if f in given]
        given["params"] = ML.EnsembleParams(**{f: given.pop(f) for f in names})
    rows = JOBS[job][0](spark or SparkSession.builder.appName(f"sigwin-{job}").getOrCreate(), **given)
    rows.show(100, truncate=False)
