"""The prediction plan on a streaming source gives the batch result."""

import os

import pytest

from sigwin import schemas as S
from sigwin.operators import models as ML
from sigwin.streaming import score_stream
from tests.test_models import SMALL, toy


def test_stream_scoring_equals_batch(spark, scratch):
    df = toy(spark, 60)
    fitted = ML.fit_ensemble(df, params=SMALL)
    src = os.path.join(scratch, "in")
    df.limit(30).write.parquet(os.path.join(src, "a"))
    df.subtract(df.limit(30)).write.mode("append").parquet(os.path.join(src, "b"))
    spark.read.parquet(os.path.join(src, "a")).unionByName(
        spark.read.parquet(os.path.join(src, "b"))).write.parquet(os.path.join(scratch, "all"))
    q = score_stream(spark, fitted, os.path.join(scratch, "all"), os.path.join(scratch, "out"),
                     os.path.join(scratch, "ckpt"))
    q.awaitTermination(120)
    got = spark.read.parquet(os.path.join(scratch, "out"))
    want = ML.predict(spark.read.parquet(os.path.join(scratch, "all")), fitted)
    a = sorted((r[0], r[1], round(r[4], 9)) for r in got.collect())
    b = sorted((r[0], r[1], round(r[4], 9)) for r in want.collect())
    assert a == b and len(a) == 60
