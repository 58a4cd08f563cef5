"""Sortable longs, medians by radix selection, running sums over adaptive ranges."""

import math
import random
import statistics
import struct

import pytest
from sigwin.functions.radix import with_sortable_long
from sigwin.operators import clean, medians, ranges
from tests.helpers import events_df


def _bits(x):
    return struct.unpack("<q", struct.pack("<d", abs(x)))[0]


def test_sortable_long_is_the_bits_of_the_double(spark):
    rnd = random.Random(4)
    xs = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308,
          math.inf, -math.inf, 0.1, 3.0, 2.0 ** 1023, 2.0 ** -1022, math.nextafter(1, 0), math.nextafter(2.0 ** 60, 0)]
    xs += [rnd.choice([-1, 1]) * 2.0 ** rnd.randint(-1070, 1023) * rnd.random() for _ in range(3000)]
    xs += [math.nextafter(2.0 ** e, s) for e in range(-1000, 1000, 37) for s in (0, math.inf)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for x, key in with_sortable_long(df, "x").collect():
        assert key == (_bits(x) if x >= 0 else -_bits(x)), x
    odd = spark.createDataFrame([(None, 0), (float("nan"), 1)], "x double, i int")
    assert [r["key"] for r in with_sortable_long(odd, "x").orderBy("i").collect()] == [-(1 << 63), (1 << 63) - 1]


def _random_events(seed, n):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        p = 0 if rnd.random() < 0.4 else rnd.randrange(1, 30)
        kind = rnd.random()
        v = None if kind < 0.1 else round(rnd.gauss(0, 3), 1) if kind < 0.6 else 80 + rnd.random() * 1e-12 if kind < 0.9 \
            else rnd.choice([math.inf, -math.inf, 0.0, -0.0, 1e-310, 1e300])
        rows.append(("ENST1.1", p, "GGACT", v, rnd.random(), None if p == 3 else float(rnd.randrange(3)), 1.0, 1.0, i))
    return rows


@pytest.mark.parametrize("rounds,digits", [(medians.ROUNDS, medians.DIGITS), (medians.ROUNDS, 0), (medians.ROUNDS, 9),
                                           ((1, 33, 64), 0)])
def test_exact_medians_are_brute_force(spark, rounds, digits, monkeypatch):
    monkeypatch.setattr(medians.middle_values, "__defaults__", (rounds,))
    monkeypatch.setattr(medians, "DIGITS", digits)
    rows = _random_events(11, 1500)
    columns = ["event_level_mean", "event_stdv", "event_length"]
    got = {r["position"]: r for r in
           medians.exact_medians(events_df(spark, rows), ["contig", "position"], columns, columns).collect()}
    for p in range(30):
        for c, at in zip(columns, (3, 4, 5)):
            vals = [r[at] for r in rows if r[1] == p and r[at] is not None]
            if vals:
                want = statistics.median(vals)
                assert got[p][c] == pytest.approx(want, rel=1e-15) or (math.isnan(want) and math.isnan(got[p][c])), (p, c)
            elif p in got:
                assert got[p][c] is None


def test_medians_take_three_counts_and_no_buffer_of_values(spark, monkeypatch):
    """At most five scans: statistics, three counts of digits, clipped means; no aggregate holds a site's values."""
    calls = []
    real = medians.prefix
    monkeypatch.setattr(medians, "prefix", lambda key, bits: calls.append(bits) or real(key, bits))
    monkeypatch.setattr(medians, "DIGITS", 0)  # as if every group were too large for its last bits at once
    df = events_df(spark, _random_events(5, 600))
    out = clean.clean_events(df)
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "percentile" not in plan and "median(" not in plan and "collect_" not in plan
    assert sorted(set(calls)) == [20, 42, 64] and len(calls) <= 5
    assert out.count() == len({(r[0], r[1]) for r in _random_events(5, 600)})


@pytest.mark.parametrize("descending", [True, False])
@pytest.mark.parametrize("bound", [1, 40])
def test_running_sums_over_skewed_values(spark, bound, descending):
    """Most values within one part in 10**13 of each other: their range is split again until it is small enough."""
    rnd = random.Random(2)
    values = {0.5 + i * 2.0 ** -50 for i in range(300)} | {rnd.uniform(-1e9, 1e9) for _ in range(60)} | {0.0, math.inf, -math.inf}
    rows = [(g, v, rnd.randrange(9), 1) for g in ("a", "b", None) for v in values if g != "b" or v < 1]
    df = spark.createDataFrame(rows, "g string, v double, x long, y long")
    got = ranges.running_before(df, "v", ["x", "y"], by=["g"], descending=descending, bound=bound).collect()
    assert len(got) == len(rows)
    for g in ("a", "b", None):
        own = sorted(((r[1], r[2]) for r in rows if r[0] == g), reverse=descending)
        want, x, y = {}, 0, 0
        for v, add in own:
            want[v] = (x, y)
            x, y = x + add, y + 1
        assert {r["v"]: (r["x_before"], r["y_before"]) for r in got if r["g"] == g} == want


def test_no_range_is_larger_than_the_bound(spark):
    rows = [(0.5 + i * 2.0 ** -50, 1) for i in range(1000)] + [(float(i), 1) for i in range(200)]
    df = spark.createDataFrame(rows, "v double, x long")
    df = with_sortable_long(df, "v", "_key")
    found = ranges.value_ranges(df, "_key", ["x"], [], True, 25)
    sizes = [r["n"] for r in found.collect()]
    assert max(sizes) <= 25 and sum(sizes) == 1200
    assert ranges.running_before(df.drop("_key").limit(0), "v", ["x"]).count() == 0
