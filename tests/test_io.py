"""TSV readers and writers, malformed input."""

import os

import pytest

from sigwin import schemas as S
from sigwin.sources import profile, sinks, tsv


def write(path, text):
    with open(path, "w") as f:
        f.write(text)
    return path


EV_HEADER = ("contig\tposition\treference_kmer\tstrand\tevent_level_mean\tevent_stdv\t"
             "event_length\tmodel_kmer\tmodel_mean\tmodel_stdv\tstandardized_level\textra\n")


def test_read_events_tokens_and_drop(spark, scratch):
    p = write(os.path.join(scratch, "ev.tsv"), EV_HEADER
              + "ENST1.1\t5\tGGACT\t+\t1.5\tnan\tinf\tX\t1\t2.0\t-inf\tz\n"
              + "ENST1.1\tx\tGGACT\t+\tbad\t1\t1\tX\t1\t2.0\t0\tz\n")
    df = tsv.read_events(spark, p)
    assert df.columns == S.EVENT_SCHEMA.fieldNames()
    rows = df.orderBy("ord").collect()
    assert rows[0]["event_stdv"] is None            # NaN becomes NULL
    assert rows[0]["event_length"] == float("inf")  # inf kept
    assert rows[0]["standardized_level"] == float("-inf")
    assert rows[1]["position"] is None and rows[1]["event_level_mean"] is None
    assert rows[0]["ord"] < rows[1]["ord"]


def test_whole_positions_with_a_zero_fraction(spark, scratch):
    p = write(os.path.join(scratch, "pos.tsv"), EV_HEADER + "".join(
        f"ENST1.1\t{x}\tGGACT\t+\t1\t1\t1\tX\t1\t2.0\t0\tz\n" for x in ("12.0", "7", "7.5", "inf", "9e99")))
    got = [r["position"] for r in tsv.read_events(spark, p).orderBy("ord").collect()]
    assert got == [12, 7, None, None, None]


def test_read_events_missing_column(spark, scratch):
    p = write(os.path.join(scratch, "bad.tsv"), "contig\tposition\n a\t1\n")
    with pytest.raises(tsv.SchemaError):
        tsv.read_events(spark, p)


def test_read_site_reference_dedup(spark, scratch):
    p = write(os.path.join(scratch, "ref.tsv"),
              "Trans\tPosition\nENST1.1\t82\nENST1.1\t82\nENST1.1\t145\n")
    assert sorted(tuple(r) for r in tsv.read_site_reference(spark, p).collect()) == [
        ("ENST1.1", 82), ("ENST1.1", 145)]


def test_read_profile_file(spark, scratch):
    p = write(os.path.join(scratch, "prof.tsv"),
              "ENST1.1\t4\t*\t0.1\tNULL\t0.9\t0.3\nENST2.1\t2\t*\t0.5\t0.6\nENST2.1\t1\n"
              "ENST1.1\t4\t*\t1\t1\t1\t1\n")
    got = sorted(tuple(r) for r in profile.read_profile(spark, p).collect())
    assert got == [("ENST1.1", i, x) for i, x in enumerate(["0.1", "NULL", "0.9", "0.3"])]


def test_read_windows_skips_long_rows(spark, scratch):
    header = "\t".join(S.WINDOW_COLUMNS)
    good = "\t".join(["ENST1.1", "3"] + ["1.0"] * 56 + ["1"])
    long = good + "\textra"
    short = "\t".join(["ENST1.1", "4"] + ["1.0"] * 10)
    p = write(os.path.join(scratch, "w.tsv"), "\n".join([header, good, long, short]) + "\n")
    df, seen = tsv.read_windows(spark, p, with_accounting=True)
    tsv.check_window_columns(df)
    assert len(df.collect()) == 2
    assert seen.get == {"lines_read": 3, "lines_skipped": 1, "lines_dropped": 0}
    from sigwin.operators.windows import finite_filter
    assert finite_filter(df).count() == 1


def test_read_windows_drops_what_is_no_whole_number(spark, scratch):
    header = "\t".join(S.WINDOW_COLUMNS)
    ends = [("3", "1"), ("4.0", "0.0"), ("5.7", "1"), ("6", "1.9"), ("inf", "1"), ("nan", "0"), ("7", "nan"),
            ("8", "1e30"), ("x", "1"), ("9", ""), ("1e300", "1")]
    lines = ["\t".join(["ENST1.1", p] + ["1.0"] * 56 + [label]) for p, label in ends]
    path = write(os.path.join(scratch, "odd.tsv"), "\n".join([header, *lines]) + "\n")
    df, seen = tsv.read_windows(spark, path, with_accounting=True)
    assert sorted((r["position"], r["label"]) for r in df.collect()) == [(3, 1), (4, 0), (9, None)]
    assert seen.get == {"lines_read": 11, "lines_skipped": 0, "lines_dropped": 8}


def test_sites_round_trip(spark, scratch):
    from tests.helpers import site_rows, sites_df
    df = sites_df(spark, site_rows("ENST1.1", range(0, 5)))
    out = os.path.join(scratch, "sites_out")
    sinks.write_sites(df, out)
    back = tsv.read_sites(spark, out)
    assert sorted(back.collect()) == sorted(df.collect())


def test_inference_outputs_and_predictions(spark, scratch):
    from tests.helpers import site_rows, sites_df
    from sigwin.plans import jobs as J
    sites = sites_df(spark, site_rows("ENST1.1", range(0, 12), kmer="GGACT"))
    structure, m6a = J.inference_sets(sites)
    for fmt in ("tsv", "parquet"):
        paths = sinks.write_inference_sets(J.inference_windows(sites), os.path.join(scratch, fmt), fmt)
        for name, want in (("structure", structure), ("m6a", m6a)):
            back = tsv.read_windows(spark, paths[name]) if fmt == "tsv" else spark.read.parquet(paths[name])
            assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect()))
    assert structure.count() == m6a.count() == 6 and {r["label"] for r in structure.collect()} == {-1}


def test_first_row_over_many_files_follows_their_names(spark, scratch):
    from sigwin.operators.clean import first_model_stdv
    folder = os.path.join(scratch, "many")
    os.makedirs(folder)
    row = "ENST1.1\t5\tGGACT\t+\t1.5\t1\t1\tX\t1\t{}\t0\tz\n"
    write(os.path.join(folder, "a.tsv"), EV_HEADER + row.format("2.0"))
    write(os.path.join(folder, "b.tsv"), EV_HEADER + row.format("9.0") * 500)
    assert first_model_stdv(tsv.read_events(spark, folder)).first()["model_stdv"] == 2.0
    folder = os.path.join(scratch, "profiles")
    os.makedirs(folder)
    write(os.path.join(folder, "a.tsv"), "ENST1.1\t1\t*\t0.1\n")
    write(os.path.join(folder, "b.tsv"), "ENST1.1\t1\t*\t0.9\n" * 500)
    assert [tuple(r) for r in profile.read_profile(spark, folder).collect()] == [("ENST1.1", 0, "0.1")]


def test_training_windows_and_predictions_round_trip(spark, scratch):
    rows = [("ENST1.1", i, *[float(i)] * len(S.FEATURES), i % 2) for i in (3, 1, 2)]
    df = spark.createDataFrame(rows, S.WINDOW_SCHEMA)
    keyed = df.selectExpr("*", "string(10 - position) AS shuffle_key")
    out = os.path.join(scratch, "train")
    sinks.write_training_windows(keyed, out, shuffle_col="shuffle_key")
    back = tsv.read_windows(spark, out)
    tsv.check_window_columns(back)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    pred = spark.createDataFrame([("ENST1.1", 2, 0.25, 0.75, 0.5), ("ENST1.1", 1, 0.0, 1.0, 0.5)],
                                 ["contig", "position", *S.PREDICTION_COLUMNS[2:]])
    out = os.path.join(scratch, "pred")
    sinks.write_predictions(pred, out)
    back = spark.read.option("sep", "\t").option("header", True).csv(out)
    assert back.columns == S.PREDICTION_COLUMNS
    assert sorted((r[0], int(r[1]), *map(float, r[2:])) for r in back.collect()) == sorted(map(tuple, pred.collect()))
