"""Site joins, profile lookup, reactivity cut."""

import pytest
from pyspark.sql import functions as F

from sigwin.operators import labels as L
from sigwin.operators import windows as W
from sigwin.sources import tsv
from tests.helpers import site_rows, sites_df


def windows(spark, contig="ENST00000416718.2", positions=range(78, 86)):
    return W.windows_wide(sites_df(spark, site_rows(contig, positions)))


def ref(spark, rows):
    return spark.createDataFrame(rows, "tx string, pos1 long")


def test_site_matches_centre_plus_one(spark):
    w = windows(spark)  # centres 81, 82
    lab = L.label_by_sites(w, ref(spark, [("ENST00000416718.2", 82)]))
    got = {r["position"]: r["label"] for r in lab.collect()}
    assert got == {81: 1, 82: 0}
    lab = L.label_by_sites(w, ref(spark, [("ENST00000416718.2", 81)]))
    assert {r["position"]: r["label"] for r in lab.collect()} == {81: 0, 82: 0}


def test_contig_suffix_and_missing_prefix(spark):
    w = windows(spark, "ENST00000416718.2|x")
    lab = L.label_by_sites(w, ref(spark, [("ENST00000416718.2", 82)]))
    assert {r["position"]: r["label"] for r in lab.collect()} == {81: 1, 82: 0}
    w2 = windows(spark, "XX")
    assert {r["label"] for r in L.label_by_sites(w2, ref(spark, [("XX", 82)])).collect()} == {0}
    from sigwin.functions.columns import contig_key
    keys = spark.createDataFrame([("ENST00000416718.2|x",), ("XX",)], "c string").select(
        contig_key("c").alias("k")).collect()
    assert [r["k"] for r in keys] == ["ENST00000416718.2", None]


def test_positive_and_negative_partition_the_windows(spark):
    w = windows(spark, positions=range(0, 40))
    r = ref(spark, [("ENST00000416718.2", p) for p in range(0, 40, 3)])
    pos, neg = L.sites_positive(w, r), L.sites_negative(w, r)
    a = {x["position"] for x in pos.collect()}
    b = {x["position"] for x in neg.collect()}
    assert not (a & b) and (a | b) == {x["position"] for x in w.collect()}
    u = L.union_classes(pos, neg)
    assert sorted((x["position"], x["label"]) for x in u.collect()) == sorted(
        (x["position"], x["label"]) for x in L.label_by_sites(w, r).collect())


def test_profile_index_is_zero_based_centre(spark):
    w = W.windows_wide(sites_df(spark, site_rows("ENST1.1", range(0, 10))))  # centres 3..6
    prof = spark.createDataFrame([("ENST1.1", ["0.1", "0.5", "0.9", "0.1", "0.5", "0.9"])],
                                 "tx string, scores array<string>")
    looked = L.profile_lookup(w, tsv.profile_to_long(prof))
    got = {r["position"]: r["score"] for r in looked.collect()}
    assert got == {3: "0.1", 4: "0.5", 5: "0.9", 6: None}
    lab = {r["position"]: r["label"] for r in L.structure_label(looked).collect()}
    assert lab == {3: 0, 5: 1}


def test_profile_duplicates_and_short_rows(spark):
    lines = spark.createDataFrame([
        ("A\t3\t*\t0.1\t0.2", 0), ("A\t3\t*\t0.9\t0.9", 1),
        ("B\t3\t*\t0.1", 2), ("B\t3", 3),
        ("C\t3", 4), ("C\t3\t*\t0.1", 5),
        ("  ", 6)], "value string, ord long")
    got = {r["tx"]: r["scores"] for r in tsv.parse_profile_lines(lines).collect()}
    assert got == {"A": ["0.1", "0.2"], "B": [], "C": []}


@pytest.mark.parametrize("score,label", [
    ("0.2", 0), ("0.8", 1), ("0.20001", None), ("nan", None), ("NULL", None),
    ("inf", 1), ("-inf", 0), ("abc", None), (None, None)])
def test_reactivity_cut(spark, score, label):
    df = spark.createDataFrame([(score,)], "score string")
    out = L.structure_label(df).collect()
    assert (out[0]["label"] if out else None) == label
