"""What keeps the cost of the steps bounded: medians of small sites, profile look-ups, gradient sums, forest walks."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from sigwin.operators import labels, medians, network


def _values(spark):
    """Sites of 1 to 60 rows with missing values, and one without any value."""
    rnd, rows = random.Random(7), []
    for site, n in enumerate((1, 2, 3, 8, 9, 60)):
        rows += [("A", site, rnd.choice([rnd.gauss(0, 5), 1.5, None]), float(i) if i % 3 else None) for i in range(n)]
    return rows + [("A", 99, None, None), ("A", 99, None, None)]


@pytest.mark.parametrize("direct", [0, 1, 8, 4096])
def test_medians_of_small_and_large_sites_are_brute_force(spark, direct):
    rows = _values(spark)
    df = spark.createDataFrame(rows, "contig string, position long, a double, b double")
    found = medians.exact_medians(df, ["contig", "position"], ["a", "b"], ["ma", "mb"], direct).collect()
    got = {r["position"]: (r["ma"], r["mb"]) for r in found}
    want = {}
    for site in {r[1] for r in rows}:
        both = [[r[c] for r in rows if r[1] == site and r[c] is not None] for c in (2, 3)]
        if any(both):
            want[site] = tuple(statistics.median(v) if v else None for v in both)
    assert len(found) == len(got) and got == {k: pytest.approx(v) for k, v in want.items()}


def test_small_sites_take_no_rounds(spark, monkeypatch):
    """Only rows of sites above the bound are counted by digits."""
    seen, real = [], medians.long_values
    monkeypatch.setattr(medians, "long_values", lambda df, *a: seen.append(df.count()) or real(df, *a))
    df = spark.createDataFrame(_values(spark), "contig string, position long, a double, b double")
    args = (["contig", "position"], ["a", "b"], ["ma", "mb"])
    medians.exact_medians(df, *args).collect()
    assert seen == []
    medians.exact_medians(df, *args, direct=9).collect()
    assert seen == [60]


def test_no_map_of_a_profile_look_up_is_long(spark):
    """Maps are searched entry by entry; every position, gap and NULL is found as it is."""
    scores = {p: f"0.{p % 97}" if p % 5 else None for p in range(0, 9000) if p % 41}
    long = spark.createDataFrame([("ENST1.1", p, s) for p, s in scores.items()], "tx string, pos long, score string")
    sizes = labels.lookup_pieces(long).select(F.size("parts").alias("n"), F.explode(F.map_values("parts")).alias("m"))
    assert sizes.agg(F.max(F.greatest("n", F.size("m")))).first()[0] <= 64
    windows = spark.createDataFrame([("ENST1.1|x", p) for p in range(-70, 9100)] + [("XX", 5)], "contig string, position long")
    for most in (None, 0):
        got = {(r["contig"], r["position"]): r["score"] for r in labels.profile_lookup(windows, long, most).collect()}
        assert got == {(c, p): scores.get(p) if c != "XX" else None for c, p in
                       [("ENST1.1|x", p) for p in range(-70, 9100)] + [("XX", 5)]}


def test_driver_gets_one_vector_a_round(spark):
    rows = [([float(i % 7), float(i % 3)], i % 2, False) for i in range(60)]
    df = spark.createDataFrame(rows, "x array<double>, label int, valid boolean")
    blocks = network.feature_blocks(df.repartition(6)).repartition(6)
    net = network.Network.start((2, 3, 2), 1)
    sums = network.summed_blocks(blocks, 6, net, 1.0, 2.0)
    assert sums.count() == 1
    assert network.round_sums(blocks, 6, net, 1.0, 2.0)[1][0] == 60


def test_forest_walk_runs_a_batch_at_a_time(spark):
    """No expression walks the trees for each row; missing and NaN values go right, as in the walk by expressions."""
    from sigwin.operators import forest
    nodes = spark.createDataFrame([
        (0, 0, 9, 1, 0.5, 1, 2, 1.0, 0.5, 0.0, [5.0, 4.0]), (0, 1, 5, -1, None, -1, -1, -1.0, 0.0, 0.0, [4.0, 1.0]),
        (0, 2, 4, 0, 2.0, 3, 4, 1.0, 0.0, 1.0, [1.0, 3.0]), (0, 3, 2, -1, None, -1, -1, -1.0, 0.0, 1.0, [0.0, 2.0]),
        (0, 4, 2, -1, None, -1, -1, -1.0, 0.0, 1.0, [0.0, 0.0]), (3, 0, 9, -1, None, -1, -1, -1.0, 0.0, 0.0, [1.0, 3.0])],
        forest.NODES)
    x = [([0.0, 0.5], 0.2), ([0.0, 0.6], 1.0), ([3.0, 0.6], 0.0), ([float("nan"), 9.0], 0.0), ([None, 9.0], 0.0), ([9.0, None], 0.0)]
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(x)], "k int, x array<double>")
    walked = forest.walked_probability(df, nodes, "x", 2, "w")
    assert "aggregate(" not in walked._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {r["k"]: r["w"] for r in walked.collect()} == {i: pytest.approx((p + 0.75) / 2) for i, (_, p) in enumerate(x)}
    assert walked.columns == ["k", "x", "w"]
