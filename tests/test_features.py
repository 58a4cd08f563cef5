"""Scaler (population std, zero -> 1) and class weights."""

import pytest

from sigwin.operators import features as FE


def test_scaler_population_std_and_zero_scale(spark):
    df = spark.createDataFrame([(1.0, 4.0), (2.0, 4.0), (3.0, 4.0)], "a double, b double")
    st = {r["feature"]: r for r in FE.scaler_stats(df, ["a", "b"]).collect()}
    assert st["a"]["std"] == pytest.approx(0.816497, abs=1e-6)
    assert st["b"]["std"] == 0.0 and st["b"]["scale"] == 1.0
    scaled = FE.scale_with_stats(df, FE.scaler_stats(df, ["a", "b"]), keep=[])
    vals = sorted(r["a"] for r in scaled.collect())
    assert vals == pytest.approx([-1.224745, 0.0, 1.224745], abs=1e-6)
    assert {r["b"] for r in scaled.collect()} == {0.0}


def test_class_weights_balanced(spark):
    df = spark.createDataFrame([(1,), (0,), (0,), (0,)], "label int")
    w = {r["label"]: r["weight"] for r in FE.class_weights(df).collect()}
    assert w[1] == pytest.approx(2.0) and w[0] == pytest.approx(0.666667, abs=1e-6)
