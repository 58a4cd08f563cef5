"""The file-to-file jobs against the same jobs on frames."""

import pytest

from sigwin import schemas as S
from sigwin.operators import labels as L
from sigwin.operators import models as ML
from sigwin.operators import windows as W
from sigwin.plans import files
from sigwin.plans import jobs as J
from sigwin.session import stored
from sigwin.sources import fixtures as FX
from sigwin.sources import profile, sinks, tsv

from tests.conftest import SF001

SMALL = ML.EnsembleParams(num_trees=5, max_depth=3, hidden_layers=[4], max_iter=5)


def _rows(df):
    return sorted(tuple(r) for r in df.select("contig", "position", "label").collect())


def _counts(df):
    return dict(map(tuple, df.collect()))


def test_jobs_from_events_to_predictions(spark, scratch):
    events = FX.event_table(spark, SF001)
    events.write.option("sep", "\t").option("header", True).csv(f"{scratch}/events")
    known = FX.site_reference(spark, SF001)
    known.write.option("sep", "\t").option("header", True).csv(f"{scratch}/known")
    cells = FX.profile_fields(spark, SF001).orderBy("file", "start", "row").collect()
    with open(f"{scratch}/profile", "w") as f:
        f.write("".join(c["value"] if c["value"].endswith("\n") else c["value"] + "\t" for c in cells))

    rows = _counts(files.clean_file(spark, f"{scratch}/events", f"{scratch}/sites"))
    sites = tsv.read_sites(spark, f"{scratch}/sites")
    assert sites.count() == events.select("contig", "position").distinct().count() == rows["sites"]
    assert rows["events"] == events.count() and rows["events_without_key"] == 0

    rows = _counts(files.m6a_set_file(spark, f"{scratch}/sites", f"{scratch}/known", f"{scratch}/m6a"))
    motif = W.motif_filter(W.context_windows(sites))
    made = _rows(J.m6a_training_set(sites, known))
    assert rows == {"sites": sites.count(), "windows": W.windows_wide(sites).count(),
                    "without_motif": W.windows_wide(sites).count() - motif.count(),
                    "not_finite": motif.count() - len(made), "label_0": sum(r[2] == 0 for r in made),
                    "label_1": sum(r[2] == 1 for r in made)}
    assert _rows(tsv.read_windows(spark, f"{scratch}/m6a")) == _rows(J.m6a_training_set(sites, known))

    files.main(["clean", f"{scratch}/events", f"{scratch}/clustered", "--format", "clustered"], spark)
    again = files.m6a_set_file(spark, f"{scratch}/clustered", f"{scratch}/known", f"{scratch}/m6a2", layout="clustered")
    assert _counts(again) == rows
    assert _rows(tsv.read_windows(spark, f"{scratch}/m6a2")) == made

    files.main(["structure-set", f"{scratch}/sites", f"{scratch}/profile", f"{scratch}/st", "--format", "parquet"],
               spark)
    scores = profile.read_profile(spark, f"{scratch}/profile")
    assert sorted(scores.collect()) == sorted(profile.profile_scores(FX.profile_fields(spark, SF001)).collect())
    want = _rows(J.structure_training_set(sites, scores))
    assert want and _rows(spark.read.parquet(f"{scratch}/st")) == want

    rows = _counts(files.structure_set_file(spark, f"{scratch}/sites", f"{scratch}/profile", f"{scratch}/st.tsv"))
    finite = W.finite_filter(W.windows_wide(sites))
    looked_up = L.profile_lookup(finite, scores)
    assert rows == {"sites": sites.count(), "windows": W.windows_wide(sites).count(),
                    "not_finite": W.windows_wide(sites).count() - finite.count(),
                    "without_score": looked_up.where("score IS NULL").count(),
                    "label_0": sum(r[2] == 0 for r in want), "label_1": sum(r[2] == 1 for r in want)}
    odd = "\t".join(["ENST1.1", "5.5", *["1"] * 57])
    long = "\t".join(["ENST1.1", *["1"] * 59])
    infinite = "\t".join(["ENST1.1", "5", "inf", *["1"] * 56])
    with open(f"{scratch}/st.tsv/part-more.csv", "w") as f:
        f.write("\n".join(["\t".join(S.WINDOW_COLUMNS), odd, long, infinite]) + "\n")
    files.main(["fit", f"{scratch}/st.tsv", f"{scratch}/fit", "--trees", "5", "--depth", "3", "--layers", "4", "--rounds", "5",
                "--ratio", "0.3", "--seed", "1", "--min-split", "3", "--alpha", "0.5", "--gamma", "1"], spark)
    fitted = ML.FittedEnsemble.load(spark, f"{scratch}/fit/model")
    assert fitted.params == ML.EnsembleParams(num_trees=5, max_depth=3, hidden_layers=[4], max_iter=5, valid_ratio=0.3, seed=1,
                                              min_split=3, alpha=0.5, gamma=1.0)
    history = spark.read.option("sep", "\t").option("header", True).csv(f"{scratch}/fit/history").collect()
    assert 2 < len(history) <= 2 * SMALL.max_iter and {r["split"] for r in history} == {"train", "valid"}
    counts = {k: int(n) for k, n in spark.read.option("sep", "\t").option("header", True).csv(f"{scratch}/fit/rows").collect()}
    assert counts == {"lines_read": len(want) + 3, "lines_skipped": 1, "lines_dropped": 1, "windows": len(want) + 1,
                      "not_finite": 1, "label_0": rows["label_0"], "label_1": rows["label_1"]}

    rows = _counts(files.inference_sets_files(spark, f"{scratch}/sites", f"{scratch}/infer"))
    both = [t.count() for t in J.inference_sets(sites)]
    assert (rows["structure"], rows["m6a"]) == tuple(both) and rows["windows"] - rows["not_finite"] == both[0]
    rows = _counts(files.predict_file(spark, f"{scratch}/infer/set=structure", f"{scratch}/fit/model", f"{scratch}/pred"))
    assert rows == {"lines_read": both[0], "lines_skipped": 0, "lines_dropped": 0, "not_finite": 0, "predictions": both[0]}
    pred = spark.read.option("sep", "\t").option("header", True).csv(f"{scratch}/pred")
    assert pred.columns == S.PREDICTION_COLUMNS
    assert pred.count() == J.inference_sets(sites)[0].count()


def test_counts_do_not_scan_again(spark, scratch):
    """The file jobs start as many jobs with counts as the work takes without them."""
    FX.event_table(spark, SF001).write.option("sep", "\t").option("header", True).csv(f"{scratch}/events")
    sc, used = spark.sparkContext, {}
    for name in ("plain", "counted"):
        sc.setJobGroup(name, name)
        if name == "plain":
            sinks.write_sites(stored(J.clean(tsv.read_events(spark, f"{scratch}/events")), "sites"), f"{scratch}/{name}")
        else:
            rows = files.clean_file(spark, f"{scratch}/events", f"{scratch}/{name}")
        used[name] = len(sc.statusTracker().getJobIdsForGroup(name))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert rows.count() == 3 and used["counted"] == used["plain"]


def test_fit_refuses_other_columns(spark, scratch):
    with open(f"{scratch}/w.tsv", "w") as f:
        f.write("contig\tposition\nENST1\t1\n")
    with pytest.raises(tsv.SchemaError):
        files.fit_file(spark, f"{scratch}/w.tsv", f"{scratch}/fit")
