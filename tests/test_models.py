"""Ensemble fit / predict / persist on a separable toy window table."""

import os
import random

import pytest
from pyspark.sql import functions as F

from sigwin import schemas as S
from sigwin.operators import metrics as M
from sigwin.operators import models as ML
from sigwin.plans import jobs as J
from sigwin.sources.tsv import SchemaError

SMALL = ML.EnsembleParams(num_trees=10, max_depth=4, hidden_layers=[8], max_iter=30)


def toy(spark, n=200):
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        label = i % 2
        feats = [rnd.gauss(2.0 * label, 0.5) for _ in range(len(S.FEATURES))]
        rows.append(("ENST1.1", i, *feats, label))
    return spark.createDataFrame(rows, S.WINDOW_SCHEMA)


def test_fit_predict_save_load(spark, scratch):
    df = toy(spark)
    fitted = ML.fit_ensemble(df, params=SMALL)
    pred = ML.predict(df.drop("label"), fitted)
    assert pred.columns == S.PREDICTION_COLUMNS
    rows = pred.collect()
    assert all(0.0 <= r[c] <= 1.0 for r in rows for c in S.PREDICTION_COLUMNS[2:])
    scored = pred.join(df.select("contig", "position", "label"), ["contig", "position"])
    auc = M.roc_auc(scored.withColumnRenamed("Combined_Prob", "score")).first()["auc"]
    assert auc > 0.95
    path = os.path.join(scratch, "model")
    fitted.save(path)
    again = ML.FittedEnsemble.load(spark, path)
    a = sorted(tuple(r) for r in pred.collect())
    b = sorted(tuple(r) for r in ML.predict(df.drop("label"), again).collect())
    assert [x[:2] for x in a] == [x[:2] for x in b]
    for x, y in zip(a, b):
        assert x[2:] == pytest.approx(y[2:])


def test_fit_job_report(spark):
    fitted, report = J.fit(toy(spark), SMALL)
    rows = report.collect()
    assert {r["split"] for r in rows} == {"train", "valid"}
    assert {r["model"] for r in rows} == {"NeuralNetwork", "RandomForest", "Combined"}
    assert sum(r["n"] for r in rows if r["model"] == "Combined") == 200
    assert [r["n"] for r in rows if r["split"] == "valid"][0] == 40


def test_fit_job_counts_replicates_once(spark):
    df = toy(spark).withColumn("position", F.col("position") % 50)
    _, report = J.fit(df, SMALL)
    assert sum(r["n"] for r in report.collect() if r["model"] == "RandomForest") == 200


def test_fit_job_rejects_unusable_input(spark):
    with pytest.raises(SchemaError):
        J.fit(toy(spark, 10).drop(S.FEATURES[3]), SMALL)
    with pytest.raises(ValueError, match="no finite training row"):
        ML.fit_ensemble(toy(spark, 10).where("position < 0"), params=SMALL)


def test_predict_drops_non_finite(spark):
    df = toy(spark, 40)
    fitted = ML.fit_ensemble(df, params=SMALL)
    bad = df.drop("label").withColumn(S.FEATURES[0], F.when(F.col("position") < 5, float("inf"))
                                      .otherwise(F.col(S.q(S.FEATURES[0]))))
    assert ML.predict(bad, fitted).count() == 35


def _forest(spark, min_split, depth=4):
    params = ML.EnsembleParams(num_trees=7, max_depth=depth, min_split=min_split, hidden_layers=[2], max_iter=2)
    rows = toy(spark, 120).withColumn("label", F.when(F.col("position") % 5 == 0, 1 - F.col("label")).otherwise(F.col("label")))
    fitted = ML.fit_ensemble(rows, params=params)
    return fitted, ML.scaled_arrays(rows, fitted, ["position"])


@pytest.mark.parametrize("min_split", [0, 5, 40])
def test_forest_is_its_node_table(spark, min_split):
    """No node under the minimum is split; walking the table gives what Spark ML gives; brute force agrees."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from sigwin.operators import forest
    fitted, arrays = _forest(spark, min_split)
    nodes = forest.node_table(spark, fitted.forest)
    table = {(r["tree"], r["node"]): r for r in nodes.collect()}
    assert all(r["left"] < 0 or r["n"] >= min_split for r in table.values())
    assert any(r["left"] >= 0 for r in table.values()) and len({t for t, _ in table}) == 7
    walked = forest.walked_probability(arrays, nodes, "x", 4, "walked")
    scored = fitted.forest.transform(walked.withColumn("features", array_to_vector("x")))
    rows = scored.select("x", "walked", F.get(vector_to_array("rf_prob"), F.lit(1)).alias("p")).collect()
    for x, w, p in rows:
        total = 0.0
        for t in range(7):
            node = table[t, 0]
            while node["left"] >= 0:
                node = table[t, node["left"] if x[node["feature"]] <= node["threshold"] else node["right"]]
            total += node["stats"][1] / sum(node["stats"])
        assert w == pytest.approx(p, abs=1e-12) and w == pytest.approx(total / 7, abs=1e-12)


def test_collapsing_nothing_changes_nothing(spark):
    from sigwin.operators import forest
    fitted, _ = _forest(spark, 0)
    before = forest.node_table(spark, fitted.forest).orderBy("tree", "node").collect()
    assert forest.collapsed(forest.node_table(spark, fitted.forest), 0).orderBy("tree", "node").collect() == before
    after = forest.node_table(spark, forest.with_min_split(spark, fitted.forest, 0)).orderBy("tree", "node").collect()
    assert after == before


def test_focal_gradient_is_that_of_finite_differences():
    import numpy as np
    from sigwin.operators.network import Network
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(40, 5)), rng.integers(0, 2, 40)
    for alpha, gamma in ((1.0, 2.0), (0.3, 0.0), (1.0, 0.5)):
        net = Network.start((5, 6, 4, 2), 1)
        net = Network(net.layers, net.weights + rng.normal(0, 0.1, len(net.weights)))
        losses, gradient, p = net.loss_and_gradient(x, y, alpha, gamma)
        assert p == pytest.approx(net.probability(x))
        z = net.forward(x)[-1]
        true = np.exp(z[np.arange(40), y]) / np.exp(z).sum(1)
        assert losses == pytest.approx(alpha * (1 - true) ** gamma * -np.log(true))
        for i in range(0, len(gradient), 3):
            step = np.zeros(len(gradient))
            step[i] = 1e-6
            ends = [Network(net.layers, net.weights + s * step).loss_and_gradient(x, y, alpha, gamma)[0].sum() for s in (1, -1)]
            assert gradient[i] == pytest.approx((ends[0] - ends[1]) / 2e-6, abs=1e-5)


def test_network_sums_do_not_depend_on_tasks_and_history_is_that_of_the_rows(spark, monkeypatch):
    import numpy as np
    from sigwin.operators import network
    rng = np.random.default_rng(2)
    rows = [([float(v) for v in rng.normal(k % 2, 1, 3)], k % 2, k % 4 == 0) for k in range(300)]
    df = spark.createDataFrame(rows, "x array<double>, label int, valid boolean")
    net = network.Network.start((3, 5, 2), 3)
    one = network.round_sums(network.feature_blocks(df.repartition(1)), 1, net, 1.0, 2.0)
    monkeypatch.setattr(network, "SUMMED", 2)
    monkeypatch.setattr(network, "ROWS", 7)
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    try:
        many = network.round_sums(network.feature_blocks(df.repartition(9)), 9, net, 1.0, 2.0)
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert many[0] == pytest.approx(one[0]) and many[1] == pytest.approx(one[1])
    training = network.fit_network(df, (3, 5, 2), rounds=30, seed=3)
    assert {h[:3] for h in training.history if h[0] == 0} == {(0, "train", 225), (0, "valid", 75)}
    losses = [h[3] for h in training.history if h[1] == "train"]
    assert losses == sorted(losses, reverse=True) and losses[-1] < losses[0]
    valid = [r for r in rows if r[2]]
    p = training.network.probability(np.array([r[0] for r in valid]))
    scored = spark.createDataFrame([(int(r[1]), float(q)) for r, q in zip(valid, p)], "label int, score double")
    auc, ap = M.roc_auc(scored).first()["auc"], M.average_precision(scored).first()["ap"]
    assert any(h[4] == pytest.approx(auc, abs=2e-3) and h[5] == pytest.approx(ap, abs=2e-3)
               for h in training.history if h[1] == "valid")
