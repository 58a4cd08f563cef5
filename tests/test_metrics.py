"""Focal loss, ROC AUC, average precision and the running sums, against
hand values and a NumPy brute force."""

import math
import random

import numpy as np
import pytest

from sigwin.operators import metrics as M


def scored(spark, labels, scores):
    return spark.createDataFrame(list(zip(labels, [float(s) for s in scores])),
                                 "label int, score double")


def brute_auc(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a == 0]
    if not pos or not neg:
        return 0.0
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def brute_ap(y, s):
    y, s = np.asarray(y), np.asarray(s)
    P = y.sum()
    ap = 0.0
    for t in sorted(set(s.tolist()), reverse=True):
        sel = s >= t
        tp = y[sel].sum()
        prec = tp / sel.sum()
        at = ((s == t) & (y == 1)).sum()
        ap += at / P * prec
    return ap


def test_hand_values(spark):
    df = scored(spark, [1, 0, 1, 0], [0.9, 0.5, 0.5, 0.1])
    assert M.roc_auc(df).first()["auc"] == pytest.approx(0.875)
    assert M.average_precision(df).first()["ap"] == pytest.approx(0.833333, abs=1e-6)
    one = scored(spark, [1, 1], [0.2, 0.3])
    assert M.roc_auc(one).first()["auc"] == 0.0


def test_focal_loss_half(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0)], "label int, z0 double, z1 double")
    assert M.focal_loss(df).first()["loss"] == pytest.approx(0.25 * math.log(2), abs=1e-9)
    none = M.focal_loss(df, reduction="none").first()["loss"]
    assert none == pytest.approx(0.173287, abs=1e-6)


@pytest.mark.parametrize("bound", [1, 3, 100_000])
def test_against_brute_force(spark, bound):
    rnd = random.Random(3)
    y = [rnd.random() < 0.3 for _ in range(600)]
    s = [round(rnd.random(), 2) for _ in range(600)]
    y = [int(v) for v in y]
    df = scored(spark, y, s)
    t = M.running_before(
        df.groupBy("score").agg({"label": "sum"}).withColumnRenamed("sum(label)", "tp"),
        "score", ["tp"], bound=bound)
    rows = {r["score"]: r["tp_before"] for r in t.collect()}
    for sc, before in rows.items():
        assert before == sum(a for a, b in zip(y, s) if b > sc)
    assert M.roc_auc(df).first()["auc"] == pytest.approx(brute_auc(y, s))
    assert M.average_precision(df).first()["ap"] == pytest.approx(brute_ap(y, s))


def test_grouped_metrics_and_report(spark):
    rows = [("a", 1, 0.9, 0.0, 2.0), ("a", 0, 0.1, 0.0, -2.0), ("b", 1, 0.4, 0.0, 0.5),
            ("b", 0, 0.6, 0.0, -0.5)]
    df = spark.createDataFrame(rows, "split string, label int, score double, z0 double, z1 double")
    rep = {r["split"]: r for r in M.metric_report(df, "split").collect()}
    assert rep["a"]["auc"] == 1.0 and rep["b"]["auc"] == 0.0 and rep["a"]["n"] == 2


def test_report_reads_its_input_once(spark, scratch):
    path = f"{scratch}/scored"
    spark.createDataFrame([("a", i % 2, i / 7, 0.0, i / 9) for i in range(30)],
                          "split string, label int, score double, z0 double, z1 double").write.parquet(path)
    report = M.metric_report(spark.read.parquet(path), "split")
    got = report.first()
    assert got["auc"] == pytest.approx(brute_auc([i % 2 for i in range(30)], range(30)))
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") <= 2


def test_pr_curve_columns(spark):
    df = scored(spark, [1, 0, 1, 0], [0.9, 0.5, 0.5, 0.1])
    pr = {r["threshold"]: r for r in M.pr_curve(df).collect()}
    assert pr[0.5]["tp"] == 2 and pr[0.5]["fp"] == 1
    assert pr[0.5]["precision"] == pytest.approx(2 / 3) and pr[0.5]["recall"] == 1.0
