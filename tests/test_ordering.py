"""Seeded shuffle, exact split, sampling."""

import hashlib

from pyspark.sql import functions as F

from sigwin.operators import ordering as O


def keyed_rows(spark, n):
    return spark.createDataFrame([("c", i) for i in range(n)], "contig string, position long")


def test_shuffle_key_is_md5_of_key_and_seed(spark):
    df = keyed_rows(spark, 3)
    got = {r["position"]: r[O.KEY] for r in O.with_shuffle_key(df).collect()}
    for p, k in got.items():
        assert k == hashlib.md5(f"c|{p}|42".encode()).hexdigest()


def test_exact_split_sizes(spark):
    out = O.exact_split(keyed_rows(spark, 10), 0.2).collect()
    valid = [r for r in out if r["split"] == "valid"]
    assert len(valid) == 2 and len(out) == 10


def test_exact_split_matches_brute_force_and_is_stable(spark):
    df = keyed_rows(spark, 5000)
    a = O.exact_split(df, 0.2)
    b = O.exact_split(df.repartition(13), 0.2)
    va = {r["position"] for r in a.where("split = 'valid'").collect()}
    vb = {r["position"] for r in b.where("split = 'valid'").collect()}
    keys = sorted((hashlib.md5(f"c|{i}|42".encode()).hexdigest(), i) for i in range(5000))
    assert va == vb == {i for _, i in keys[:1000]}


def test_kth_row_with_many_groups(spark):
    rows = O._numbered(keyed_rows(spark, 250_000), ("contig", "position"), 42)
    counts = O.first_counts(rows)
    keys = sorted(hashlib.md5(f"c|{i}|42".encode()).hexdigest() for i in range(250_000))
    for k in (1, 77_777, 250_000):
        assert O.kth_row(rows, k, counts)[0] == keys[k - 1]
    assert O.kth_row(rows, 0, counts) is None and O.kth_row(rows, 250_001, counts) is None


def test_sample_all_when_asking_more(spark):
    assert O.sample_n(keyed_rows(spark, 3), 5).count() == 3
    assert O.sample_n(keyed_rows(spark, 30), 5).count() == 5


def test_split_and_sample_are_exact_on_tied_keys(spark):
    from sigwin.operators.ordering import exact_split, sample_n
    df = spark.createDataFrame([("c", 1, i) for i in range(10)], "contig string, position long, v int")
    assert sorted(r["count"] for r in exact_split(df, 0.2).groupBy("split").count().collect()) == [2, 8]
    assert sample_n(df, 3).count() == 3 and sample_n(df, 0).count() == 0


def test_one_key_is_cut_over_many_tasks(spark):
    """100,000 rows of one key in 16 tasks, exact duplicates among them: exact, and no window over the rows."""
    df = spark.range(100_000, numPartitions=16).selectExpr("'c' AS contig", "1L AS position", "id % 3 AS v")
    out = O.exact_split(df, 0.37)
    assert {r["split"]: r["count"] for r in out.groupBy("split").count().collect()} == {"valid": 37_000, "train": 63_000}
    assert out.rdd.getNumPartitions() > 1
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan
    assert O.sample_n(df, 12_345).count() == 12_345
