"""N-gram join, top-k and components against brute force; the pipeline end to end."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sigwin.llm import common, ngram_join, quality, topk
from sigwin.llm.common import stored
from sigwin.llm.components import components

from .conftest import LONG, TEXTS


def _shingles(text, n):
    words = (text or "").encode().lower().split()
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} - {()}


def _brute(rows, n, percent):
    sets = [_shingles(t, n) for _, t in rows]
    label = list(range(len(rows)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                label[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted((d or -1, len(sets[i]), (least[find(i)] if sets[i] else d) or -1 if d is not None else -1)
                  for i, (d, _) in enumerate(rows))


def _got(df, n, percent):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, -1 if r.component_id is None else r.component_id)
                  for r in ngram_join.jaccard_components(df, n, percent).collect())


def test_ngram_join_edges(docs, no_docs):
    assert _got(docs, 4, 85) == _brute(TEXTS, 4, 85)
    assert ngram_join.jaccard_components(no_docs).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns


def test_ngram_join_links_through_texts_without_id(spark):
    """A chain whose inner texts have no doc_id, one of them twice; its ends don't link with each other."""
    words = [f"w{i}" for i in range(100)]
    chain = [" ".join(words[i:i + 60]) for i in range(0, 25, 4)]
    ids = [7, None, None, 3, None, None, 9]
    rows = list(zip(ids, chain, strict=True)) + [(None, chain[1]), (None, chain[1].upper()), (None, None), (20, "x y")]
    df = stored(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "chain")
    want = _brute(rows, 4, 85)
    assert [x for x in want if x[0] in (3, 7, 9)] == [(3, 57, 3), (7, 57, 3), (9, 57, 3)]
    assert _got(df, 4, 85) == want


@pytest.mark.parametrize("percent,block,grams", [(85, 4, 1 << 17), (60, 64, 300), (60, 64, 1 << 17)])
def test_ngram_join_is_brute_force(spark, monkeypatch, percent, block, grams):
    """Chains, near copies, a passage that many share, copies; small blocks (by sets or n-grams) make many cells."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", grams)
    monkeypatch.setattr(common, "SLICE", 7)
    monkeypatch.setattr(common, "SUMMED", 2)
    rng = random.Random(percent)
    words = [f"w{i}" for i in range(300)]
    base, passage = [rng.choice(words) for _ in range(90)], [rng.choice(words) for _ in range(40)]
    rows = []
    for i in range(90):
        kind = i % 3
        if kind == 0:
            text = list(base)
            for _ in range(rng.randint(0, 6)):
                text[rng.randrange(len(text))] = rng.choice(words)
        elif kind == 1:
            text = passage + [rng.choice(words) for _ in range(rng.randint(0, 12))]
        else:
            text = [rng.choice(words) for _ in range(rng.randint(1, 30))]
        rows.append((i + 1, " ".join(text)))
    rows += [(200 + i, t.upper()) for i, (_, t) in enumerate(rows[::7])]
    df = stored(spark.createDataFrame(rows, "doc_id long, text string"), "near")
    assert _got(df, 4, percent) == _brute(rows, 4, percent)


def test_sketch_counts_every_ngram(spark, monkeypatch):
    monkeypatch.setattr(common, "SUMMED", 2)
    texts = [f"a b c d {i % 7} {i}" for i in range(60)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    want = np.zeros(1 << ngram_join.SKETCH_BITS, np.uint32)
    for t in texts:
        for h in ngram_join.shingles(t, 4):
            want[int(h) >> (64 - ngram_join.SKETCH_BITS)] += 1
    assert (ngram_join._sketch(df, 4) == want).all()
    assert not ngram_join._sketch(df.where("false"), 4).any()


def test_tree_join_finds_all_links():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 25, rng.integers(1, 25))).astype(np.uint64) for _ in range(60)]
    found = ngram_join.tree_join(list(range(60)), sets, list(range(60)), range(60), 70)
    parent = list(range(60))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in found:
        common = len(np.intersect1d(sets[a], sets[b]))
        assert ngram_join.linked(common, len(sets[a]), len(sets[b]), 70)
        parent[find(a)] = find(b)
    for i in range(60):
        for j in range(i):
            if ngram_join.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]), 70):
                assert find(i) == find(j)


def test_marks_lose_no_link_and_drop_strangers():
    """Near copies of many sizes, full counters (equal high bits) among them, against every pair."""
    rng = np.random.default_rng(3)
    for percent in (60, 80, 85):
        sets = []
        for size in (1, 3, 15, 33, 100, 255, 256, 700, 3000):
            base = rng.integers(0, 1 << 63, size, dtype=np.uint64) << np.uint64(1)
            if size == 700:
                base >>= np.uint64(40)
            for change in (0.0, 0.05, 0.1, 0.2, 0.5):
                new = rng.integers(0, 1 << 63, size, dtype=np.uint64) >> np.uint64(40 if size == 700 else 0)
                sets.append(np.unique(np.where(rng.random(size) < change, new, base)))
                sets.append(np.unique(base[rng.random(size) >= change]))
        sets = [s for s in sets if len(s)]
        sizes, probe = np.array([len(s) for s in sets]), rng.random(len(sets)) < 0.4
        labels = np.arange(len(sets))
        keep = ngram_join.may_link(sizes, [ngram_join.mark_of(s) for s in sets], labels, probe, percent)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if i != j and probe[i] and ngram_join.linked(len(np.intersect1d(a, b)), len(a), len(b), percent):
                    assert keep[i] and keep[j]
        assert not ngram_join.may_link(sizes, [ngram_join.mark_of(s) for s in sets], labels * 0, probe, percent).any()
    strangers = [np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64) << np.uint64(1)) for _ in range(40)]
    n = np.array([len(s) for s in strangers])
    marks = [ngram_join.mark_of(s) for s in strangers]
    assert not ngram_join.may_link(n, marks, np.arange(40), np.ones(40, bool), 80).any()


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 299)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 299: 299, 300: 299}


def _top(rows, k=5, every=50):
    kept = [(i, [math.floor(256 * Fraction(x)) for x in v]) for i, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, (query, v) in enumerate(kept):
        if query is not None and query % every == 0:
            scores = [(-max(-2 ** 63, min(2 ** 63 - 1, sum(a * b for a, b in zip(v, w)))), i is None, i or 0, i)
                      for c, (i, w) in enumerate(kept) if c != q]
            out += [(query, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("query_rows,slice_rows", [(1024, 8192), (4, 30)])
def test_top_k_is_brute_force(spark, query_rows, slice_rows):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(400, 10))
    v[150:170] = v[0]
    rows = [(i, [float(x) for x in v[i]]) for i in range(400)]
    rows += [(1000, None), (1050, []), (1100, [None] * 10), (1150, [float("nan")] * 10), (None, [1.0] * 10),
             (1200, [float("inf")] + [0.0] * 9), (50, rows[50][1]), (50, [2.0] * 12), (1250, [1e300, -1e300]), (7, [1e20] * 3),
             (8, [2.0 ** 44 + 0.5, -1.0])]
    df = stored(spark.createDataFrame([(*r, "c", 1) for r in rows],
                                      "vec_id long, embedding array<double>, rank string, row int").repartition(3), "vectors")
    got = topk.top_k(df, query_rows=query_rows, slice_rows=slice_rows)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(
        ((q, r, i, s) for q, r, i, s in _top(rows)), key=str)
    assert topk.top_k(df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (7, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(few).collect()] == [(0, 1, 7, 256 * 512)]


@pytest.mark.parametrize("spread,share", [(0.05, 0.02), (1.0, 0.5)])
def test_segment_statistics_drop_candidates(spread, share):
    """Of clustered vectors the coarse levels leave one cluster, of unclustered ones the finest level a part."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(80, 64))[rng.integers(0, 80, 4000)] + spread * rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    order = np.argsort(-x.var(0), kind="stable")
    stats = topk.all_statistics(topk.whole_numbers(x), order)
    floors = np.sort(topk.whole_numbers(x[:20]) @ topk.whole_numbers(x).T, axis=1)[:, -6]
    found = list(topk.best_of_slice(x[:20], stats[:20], x, stats, np.arange(20), [int(f) for f in floors], 5))
    assert sum(n for *_, n in found) < share * 20 * 4000
    assert all(len(live) >= 5 for live, _, _ in found)
    levels = topk.level_columns(64)
    scores = topk.whole_numbers(x[:20]) @ topk.whole_numbers(x).T
    assert all((topk.upper_bounds(stats[:20], stats, level) >= scores).all() for level in levels)


def test_segment_bounds_hold():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(50, 13)), rng.normal(size=(50, 13))
    exact = ((x - y) ** 2).sum(1)
    coarse, fine = (((topk.segment_statistics(x, n) - topk.segment_statistics(y, n)) ** 2).sum(1) for n in (3, 6))
    assert (coarse <= exact + 1e-9).all() and (fine <= exact + 1e-9).all()


def test_pipeline_stages(spark):
    """Each stage against brute force on what the one before kept."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stored(stage(spark, before, sf), name)
        rows = [(r.doc_id, r.text) for r in before.select("doc_id", "text").collect()]
        if name == "quality":
            labels = spark.read.parquet(f"{sf}/labels.parquet")
            report = quality.score_documents(before, labels).where("predicted = 1")
            assert {r.doc_id for r in report.collect()} == {r.doc_id for r in after.collect()}
        if name == "exact_dedup":
            last = {}
            for i, t in sorted(rows):
                last[t.encode().lower()] = i
            assert sorted(last.values()) == sorted(r.doc_id for r in after.collect())
        if name == "ngram_join":
            want = [d for d, _, c in _brute(rows, 5, 80) if c == d or c == -1]
            assert sorted(r.doc_id for r in after.collect()) == sorted(want)
        if name == "mixing":
            assert {r.doc_id for r in after.collect()} <= {i for i, _ in rows}
        if name != "byte_bpe":
            assert after.columns == docs.columns
        else:
            assert after.count() == before.count()
        before = after
    assert corpus_pipeline.run(spark, sf).agg(F.sum("n_tokens")).first()[0] == before.agg(F.sum("n_tokens")).first()[0]


CLASH = ["_score", "_row", "_sha", "_maybe", "_key", "_size", "_source", "_copies", "_copy", "__size", "SCORE", "node"]


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_of_odd_rows(spark, scratch, empty):
    """Null and empty texts, null, repeated and tied ids, copies, a very long text, columns of the stages' own names."""
    good = [" ".join(f"word{(i * 7 + k * k) % 91} and" for k in range(40 + i)) + " end." for i in range(12)]
    rows = [(i, t, "en", "s0") for i, t in enumerate(good)]
    rows += [(50, good[0].upper(), "en", "s1"), (50, good[0], "en", "s1"), (51, good[1], None, None), (None, good[2], "en", "s0"),
             (None, "only " + good[3], "en", "s0"), (60, None, "en", "s1"), (61, "", "en", "s1"), (62, LONG, "en", "s2"),
             (7, "same id, " + good[4], "en", "s0")]
    docs = spark.createDataFrame([(*r, 0, *[k] * len(CLASH)) for k, r in enumerate(rows)][:0 if empty else None],
                                 "doc_id long, text string, lang string, source string, n_chars long, "
                                 + ", ".join(f"`{c}` long" for c in CLASH))
    docs.repartition(4).write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(1, 12)] + [(None, 0, 0), (3, None, 1)], "doc_id long, quality int, toxic int"
                          ).write.parquet(f"{scratch}/labels.parquet")
    before = spark.read.parquet(f"{scratch}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, before, scratch), name)
        assert after.columns == docs.columns, name
        # Whole rows go on: each has the extra columns of its row.
        for r in after.collect():
            assert len({r[c] for c in CLASH}) == 1 and (r.doc_id, r.text, r.lang, r.source) == rows[r["_row"]], name
        if name == "exact_dedup" and not empty:
            kept = [(r.text or "").lower() for r in after.collect()]
            assert sorted(kept) == sorted({(r.text or "").lower() for r in before.collect()})
            assert {r.doc_id for r in after.collect()} >= {50, 51, 61, 62} and 60 not in {r.doc_id for r in after.collect()}
        before = after
    out = corpus_pipeline.run(spark, scratch)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
    assert sorted((r.doc_id or -1, r.n_tokens) for r in out.collect()) == sorted(
        (r.doc_id or -1, r.n_tokens) for r in corpus_pipeline.STAGES[-1][1](spark, before, scratch).collect())
    assert out.count() == before.count() and (out.count() > 0) != empty
