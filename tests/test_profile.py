"""The field-wise profile reader against a reader of whole lines; bitmaps and pieces."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sigwin.operators import labels
from sigwin.sources import profile


def _whole_lines(texts):
    """The rule on whole lines: first long line wins, any short line empties."""
    scores, short = {}, set()
    for text in texts:
        for line in re.split("\r\n|\n|\r", text):
            cells = re.sub(r"^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$", "", line).split("\t")
            if cells == [""]:
                continue
            if len(cells) < 4:
                short.add(cells[0])
            else:
                scores.setdefault(cells[0], cells[3:])
    return sorted((tx, i, x) for tx, s in scores.items() if tx not in short for i, x in enumerate(s))


def _file(rng, lines):
    out = []
    for _ in range(lines):
        tx = f"ENST{rng.randrange(9)}.1"
        kind = rng.random()
        n = 0 if kind < 0.06 else rng.randrange(1, 40)
        cells = [tx, str(n), "*"][:rng.randrange(1, 4) if kind < 0.06 else 3]
        cells += [rng.choice(["0.1", "NULL", "nan", "", " ", "0.25 "]) for _ in range(n)]
        line = "\t".join(cells) + rng.choice(["", "", "\t", " \t ", "\t\t"])
        out.append(rng.choice(["", "", " ", "\t"]) + line + rng.choice(["\n", "\n", "\r\n", "\n\n", "\n \t\n"]))
    return "".join(out)[:-1 if rng.random() < 0.5 else None]


@pytest.mark.parametrize("block,split", [(1 << 16, "128m"), (7, "64")])
def test_fields_give_what_lines_give(spark, scratch, monkeypatch, block, split):
    monkeypatch.setattr(profile, "BLOCK", block)
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", "1" if split == "64" else "4m")
    try:
        for seed in range(3):
            rng = random.Random(seed)
            texts = [_file(rng, rng.randrange(1, 30)) for _ in range(3)] + ["", "\n", "lonely"]
            for i, text in enumerate(texts):
                with open(f"{scratch}/{seed}-{i}.tsv", "w", newline="") as f:
                    f.write(text)
            got = sorted(tuple(r) for r in profile.read_profile(spark, f"{scratch}/{seed}-*.tsv").collect())
            assert got == _whole_lines(texts)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_no_row_holds_a_line(spark, scratch):
    """A line of 100,000 scores: its widest row is a field, and windows run over bounded blocks."""
    with open(f"{scratch}/long.tsv", "w") as f:
        f.write("ENST1.1\t100000\t*\t" + "\t".join(str(i) for i in range(100_000)) + "\nENST2.1\t1\t*\t7\n")
    fields = profile.read_profile_fields(spark, f"{scratch}/long.tsv")
    assert fields.agg(F.max(F.length("value"))).first()[0] < 20
    got = profile.profile_scores(fields)
    assert got.where("score <> CAST(pos AS STRING) AND tx = 'ENST1.1'").count() == 0
    assert got.groupBy("tx").count().orderBy("tx").collect() == [("ENST1.1", 100_000), ("ENST2.1", 1)]
    plan = profile.profile_scores(fields)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "collect_" not in plan


def test_site_index_has_a_row_for_each_bucket(spark):
    rng = random.Random(1)
    sites = [(f"ENST{rng.randrange(3)}.1", rng.choice([rng.randrange(1, 200_000), 32_767, 32_768, 65_536]))
             for _ in range(4000)] + [(None, 5), ("ENST1.1", None)]
    ref = spark.createDataFrame(sites, "tx string, pos1 long")
    index = labels.site_index(ref)
    assert index.count() == len({(t, p // 32_768) for t, p in sites if t and p is not None})
    rows = [(f"{t}|x" if t else "other", p - 1 + d) for t, p in sites if p is not None for d in (-1, 0, 1)]
    windows = spark.createDataFrame(rows, "contig string, position long")
    known = set(sites)
    want = sorted((c, p, int((c.split("|")[0], p + 1) in known and c != "other")) for c, p in rows)
    for limit in (None, 1):
        got = labels.label_by_sites(windows, ref, limit)
        assert sorted(tuple(r) for r in got.select("contig", "position", "label").collect()) == want
    assert labels.sites_positive(windows, ref).count() == sum(x[2] for x in want)
    assert labels.sites_negative(windows, ref).columns == ["contig", "position"]


def test_profile_pieces_are_bounded(spark):
    long = spark.range(10_000).select(F.lit("ENST1.1").alias("tx"), F.col("id").alias("pos"), F.col("id").cast("string").alias("score"))
    pieces = labels.profile_pieces(long)
    assert pieces.agg(F.max(F.size("scores"))).first()[0] == labels.PIECE and pieces.count() == 3
    windows = spark.createDataFrame([("ENST1.1|a", p) for p in (0, 4095, 4096, 9999, 10_000)], "contig string, position long")
    for limit in (None, 1):
        got = labels.profile_lookup(windows, long, limit)
        assert sorted((r["position"], r["score"]) for r in got.collect()) == [
            (0, "0"), (4095, "4095"), (4096, "4096"), (9999, "9999"), (10_000, None)]
