"""Hand tables for the cleaning rules (clip, medians, mode, first row, diff)."""

import math

import pytest

from sigwin.operators import clean as C
from tests.helpers import events_df


def ev(values, col="event_level_mean", contig="ENST1.1", pos=0, **over):
    rows = []
    for i, v in enumerate(values):
        base = {"event_level_mean": 1.0, "event_stdv": 1.0, "event_length": 1.0,
                "model_stdv": 1.0, "standardized_level": 1.0}
        base[col] = v
        base.update(over)
        rows.append((contig, pos, "GGACT", base["event_level_mean"], base["event_stdv"],
                     base["event_length"], base["model_stdv"], base["standardized_level"], i))
    return rows


def clipped(spark, values):
    df = events_df(spark, ev(values))
    return C.clipped_mean(df).collect()[0]["event_level_mean"]


def test_clip_drops_outlier(spark):
    assert clipped(spark, [10.0] * 7 + [110.0]) == pytest.approx(10.0)


def test_clip_keeps_inside_band(spark):
    assert clipped(spark, [10.0] * 6 + [110.0]) == pytest.approx(170 / 7)


def test_single_row_is_value(spark):
    assert clipped(spark, [5.0]) == 5.0


def test_null_in_multi_row_group_gives_null_but_median_skips(spark):
    df = events_df(spark, ev([1.0, None, 3.0]))
    assert C.clipped_mean(df).collect()[0]["event_level_mean"] is None
    assert C.group_median(df).collect()[0]["event_level_median"] == 2.0


def test_inf_in_group_returns_median(spark):
    assert clipped(spark, [1.0, math.inf, 3.0]) == 3.0


def test_zero_spread_returns_median(spark):
    assert clipped(spark, [2.0, 2.0]) == 2.0


def test_modal_kmer_smallest_of_ties(spark):
    rows = []
    for i, k in enumerate(["b", "a", "b", "a", "c", None]):
        rows.append(("ENST1.1", 0, k, 1.0, 1.0, 1.0, 1.0, 1.0, i))
    assert C.kmer_mode(events_df(spark, rows)).collect()[0]["reference_kmer"] == "a"


def test_first_model_stdv_keeps_null(spark):
    rows = [("ENST1.1", 0, "GGACT", 1.0, 1.0, 1.0, 2.0, 1.0, 2),
            ("ENST1.1", 0, "GGACT", 1.0, 1.0, 1.0, None, 1.0, 1)]
    assert C.first_model_stdv(events_df(spark, rows)).collect()[0]["model_stdv"] is None


def test_zero_divisor_gives_null_diff(spark):
    rows = ev([1.0], col="event_stdv", model_stdv=0.0)
    out = C.clean_events(events_df(spark, rows)).collect()[0]
    assert out["diff_stdv"] is None


def test_null_keys_dropped_and_columns(spark):
    rows = ev([1.0, 2.0]) + [(None, 1, "GGACT", 1.0, 1.0, 1.0, 1.0, 1.0, 9),
                            ("ENST1.1", None, "GGACT", 1.0, 1.0, 1.0, 1.0, 1.0, 10)]
    out = C.clean_events(events_df(spark, rows))
    assert out.columns == ["contig", "position", "reference_kmer", "event_level_mean",
                           "event_stdv", "event_length", "standardized_level",
                           "event_level_median", "event_stdv_median", "event_length_median",
                           "diff_stdv"]
    assert out.count() == 1


def test_relative_diff_formula(spark):
    rows = ev([3.0, 3.0], col="event_stdv", model_stdv=2.0)
    out = C.clean_events(events_df(spark, rows)).collect()[0]
    assert out["diff_stdv"] == pytest.approx(0.5)


def test_clean_plan_does_not_shuffle_raw_events_when_stats_are_small(spark):
    df = events_df(spark, ev([1.0, 2.0, 3.0]))
    plan = C.clean_events(df, max_broadcast_bytes=1 << 20)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_clean_result_independent_of_partitioning(spark):
    import random
    rnd = random.Random(1)
    rows = [("ENST1.1", p, "GGACT", rnd.uniform(0, 100), rnd.uniform(0, 5), rnd.random(),
             1.0, rnd.gauss(0, 1), i) for i, p in enumerate([rnd.randrange(5) for _ in range(400)])]
    df = events_df(spark, rows)
    a = sorted(C.clean_events(df).collect())
    b = sorted(C.clean_events(df.repartition(7)).collect())
    # Sums of doubles depend on their order in the last digits.
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or abs(u - v) <= 1e-9 * max(1.0, abs(u))


def test_shuffle_joins_equal_broadcast(spark):
    """Without any broadcast (statistics, digits of the medians) the site table is the same."""
    from sigwin.sources import fixtures as FX
    from sigwin.functions.columns import round_doubles
    ea = FX.event_table(spark, "/root/testdata/sf0.01")
    a = round_doubles(C.clean_events(ea)).collect()
    spark.conf.set("sigwin.broadcast.maxBytes", "1")
    try:
        b = round_doubles(C.clean_events(ea)).collect()
    finally:
        spark.conf.unset("sigwin.broadcast.maxBytes")
    key = lambda r: (r["contig"], r["position"])
    assert sorted(a, key=key) == sorted(b, key=key)


def _site(spark, values):
    rows = [("ENST1", 1, "AAAAA", float(v), 1.0, 1.0, 1.0, 0.0, i) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "contig string, position long, reference_kmer string, event_level_mean double, "
                                       "event_stdv double, event_length double, model_stdv double, "
                                       "standardized_level double, ord long")


def test_small_large_missing_and_infinite_values(spark):
    from sigwin.operators.clean import clean_events
    def run(values):
        return clean_events(_site(spark, values)).first()
    assert abs(run([1e-13, 2e-13, 3e-13])["event_level_mean"] - 2e-13) < 1e-20
    assert abs(run([9e25, 8e25, 7e25])["event_level_mean"] / 8e25 - 1) < 1e-12
    row = run([1.0, float("nan"), 3.0])
    assert row["event_level_median"] == 2.0 and row["event_level_mean"] is None
    assert run([1.0, 2.0, float("inf")])["event_level_mean"] == 2.0


def test_group_median_of_missing_values(spark):
    df = events_df(spark, ev([3.0, None, 1.0, 2.0, 2.0, 9.0], pos=1) + ev([4.0, 5.0], pos=2)
                   + ev([None, None, None, None], pos=3))
    assert {r[1]: r[2] for r in C.group_median(df).collect()} == {1: 2.0, 2: 4.5, 3: None}
