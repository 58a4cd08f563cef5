"""Context windows, motif and finite filters."""

import pytest
from pyspark.sql import functions as F

from sigwin import schemas as S
from sigwin.operators import windows as W
from tests.conftest import SF001
from tests.helpers import site_rows, sites_df


def centres(df):
    return sorted((r["contig"], r["position"]) for r in df.collect())


def test_windows_need_seven_consecutive_positions(spark):
    df = sites_df(spark, site_rows("A", list(range(0, 7)) + list(range(8, 16))))
    assert centres(W.context_centres(df)) == [("A", 3), ("A", 11), ("A", 12)]


def test_windows_never_cross_contigs(spark):
    df = sites_df(spark, site_rows("A", range(0, 4)) + site_rows("B", range(4, 7)))
    assert W.context_centres(df).count() == 0


@pytest.mark.parametrize("bucket", [7, 8, 13, 4096])
def test_bucketed_windows_equal_brute_force(spark, bucket):
    import random
    rnd = random.Random(7)
    rows = []
    for contig in ["A", "B", "C"]:
        pos = sorted(rnd.sample(range(0, 200), 150))
        rows += site_rows(contig, pos)
    df = sites_df(spark, rows)
    got = centres(W.context_centres(df, bucket=bucket))
    have = {(r[0], r[1]) for r in rows}
    want = sorted((c, p) for c, p in have
                  if all((c, p + o) in have for o in range(-3, 4)))
    assert got == want


def test_wide_names_and_values(spark):
    df = sites_df(spark, site_rows("A", range(0, 7)))
    wide = W.windows_wide(df)
    assert wide.columns == ["contig", "position"] + S.FEATURES
    r = wide.collect()[0]
    assert r["position"] == 3
    assert r["-3_event_level_mean"] == 1.0 + 0
    assert r["+3_diff_stdv"] == 1.0 + 6 + 7


def test_long_has_seven_rows_per_window(spark):
    df = sites_df(spark, site_rows("A", range(0, 8)))
    long = W.windows_long(df)
    assert long.count() == 14
    assert sorted(r["offset"] for r in long.where("position = 3").collect()) == list(range(-3, 4))


def test_motif_at_offset_minus_two(spark):
    rows = site_rows("A", range(0, 7), kmer="AAAAA")
    rows[1] = ("A", 1, "GGACT") + rows[1][3:]
    df = sites_df(spark, rows)
    assert W.motif_filter(W.context_windows(df)).count() == 1
    rows[1] = ("A", 1, "AAAAA") + rows[1][3:]
    rows[3] = ("A", 3, "GGACT") + rows[3][3:]
    assert W.motif_filter(W.context_windows(sites_df(spark, rows))).count() == 0


@pytest.mark.parametrize("kmer,keep", [
    ("GGACT", True), ("TAACA", True), ("AGACC", True), ("CGACT", False), ("GCACT", False),
    ("GGACG", False), ("ggact", False), ("GGACTA", False), ("GGAC\n", False), (None, False)])
def test_drach_rule(spark, kmer, keep):
    from sigwin.functions.columns import is_drach
    got = spark.createDataFrame([(kmer,)], "k string").select(is_drach("k").alias("x")).first()[0]
    assert got is keep


def test_first_window_of_first_contig_is_kept(spark):
    rows = site_rows("A", range(0, 7), kmer="AAAAA")
    rows[1] = ("A", 1, "GGACT") + rows[1][3:]
    out = W.motif_filter(W.context_windows(sites_df(spark, rows)))
    assert [r["position"] for r in out.collect()] == [3]


def test_finite_filter_drops_null_nan_inf(spark):
    rows = site_rows("A", range(0, 10))
    rows[4] = rows[4][:5] + (float("inf"),) + rows[4][6:]
    rows[8] = rows[8][:5] + (None,) + rows[8][6:]
    wide = W.windows_wide(sites_df(spark, rows))
    kept = [r["position"] for r in W.finite_filter(wide).collect()]
    assert kept == []  # every window of 3..6 touches 4, and 5..6 touch 8
    rows[8] = rows[8][:5] + (float("nan"),) + rows[8][6:]
    assert W.finite_filter(W.windows_wide(sites_df(spark, rows))).count() == 0


def test_one_window_node_one_exchange(spark):
    df = sites_df(spark, site_rows("A", range(0, 20)))
    wide = W.windows_wide(df)
    wide.write.format("noop").mode("overwrite").save()
    lines = wide._jdf.queryExecution().executedPlan().toString().split("\n")
    assert sum(1 for x in lines if x.strip().startswith("+- Window [")
               or x.strip().startswith("Window [")) == 1
    assert sum(1 for x in lines if "Exchange hashpartitioning" in x) == 1


def test_site_join_is_broadcast(spark):
    from sigwin.operators import labels as L
    w = W.windows_wide(sites_df(spark, site_rows("ENST1.1", range(0, 30))))
    ref = spark.createDataFrame([("ENST1.1", 5)], "tx string, pos1 long")
    j = L.label_by_sites(w, ref)
    j.write.format("noop").mode("overwrite").save()
    assert "BroadcastHashJoin" in j._jdf.queryExecution().executedPlan().toString()


def test_clustered_sites_need_no_exchange(spark, scratch):
    """Windows, motif, site labels and the finite filter over a stored clustered table: no Exchange but a broadcast's."""
    from sigwin.operators import labels as L
    from sigwin.sources import clustered
    from sigwin.sources import fixtures as FX
    from sigwin.operators import clean as C
    sites = C.clean_events(FX.event_table(spark, SF001))
    clustered.write_clustered_sites(sites, f"{scratch}/sites", files=5, bucket=64)
    back = clustered.read_clustered_sites(spark, f"{scratch}/sites")
    assert sorted(map(str, clustered.sites_of(back, 64).collect())) == sorted(map(str, sites.collect()))
    assert back.count() > sites.count()
    plain = W.windows_wide(sites)
    made = W.windows_wide(back, bucket=64)
    assert made.columns == plain.columns
    assert sorted(map(str, made.collect())) == sorted(map(str, plain.collect())) and made.count() > 0
    labelled = W.finite_filter(L.label_by_sites(W.drop_kmer_columns(W.motif_filter(W.context_windows(back, bucket=64))),
                                                FX.site_reference(spark, SF001)))
    for df in (made, labelled):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and "Exchange" not in plan.replace("BroadcastExchange", ""), plan
