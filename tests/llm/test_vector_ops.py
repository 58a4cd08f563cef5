"""Operators 11 to 13 against brute force: resampling, product codes, nearest neighbours."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sigwin.llm import nearest, resampling, vector_codes

from .conftest import TEXTS, stored


def _words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def _features(text, runs):
    w = _words(text)
    return [" ".join(w[i:i + n]) for n in range(1, runs + 1) for i in range(len(w) - n + 1)]


def _resampled(rows, target, runs, buckets, seed, percent, min_words):
    def count(texts):
        return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in _features(t, runs))

    s, t = count(x for _, x in rows), count(target)
    s_all, t_all = sum(s.values()), sum(t.values())
    out = []
    for doc_id, text in rows:
        features = _features(text, runs)
        weight = 0
        for f in features:
            b = zlib.crc32(f.encode()) % buckets
            weight += math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(features), weight, score, None, len(_words(text))])
    able = sorted((x for x in out if x[5] >= min_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for rank, x in enumerate(able[:len(able) * percent // 100], 1):
        x[4] = rank
    return Counter(tuple(x[:5]) for x in out)


TARGET = ["The quick public license", None, "", "word5 and so on word7 on and so", "naïve ßẞ 名 it's"]


@pytest.mark.parametrize("runs,buckets,percent,min_words", [(1, 10_000, 10, 20), (1, 7, 60, 1), (3, 50, 50, 2)])
def test_resampling_is_brute_force(spark, docs, monkeypatch, runs, buckets, percent, min_words):
    monkeypatch.setattr(resampling, "HELD", 50)
    rng = random.Random(1)
    more = [(100 + i % 40, " ".join(rng.choices(["Public", "license", "word5", "on", "x1", "名"], k=rng.randint(0, 40))))
            for i in range(120)]
    rows = TEXTS + more + [(None, "no id " * 30), (7, "same id " * 15), (7, "same id " * 15)]
    df = stored(spark, [(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, _score int, _ROW int, weight int")
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = resampling.importance_report(df, target, runs, buckets, 2024, percent, min_words)
    want = _resampled(rows, TARGET, runs, buckets, 2024, percent, min_words)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    kept = resampling.resampled(df, target, runs, buckets, 2024, percent, min_words)
    assert kept.columns == df.columns
    drawn = Counter(x[0] for x in want.elements() if x[4] is not None)
    assert Counter(r.doc_id for r in kept.collect()) == drawn
    assert {tuple(r[2:]) for r in kept.collect()} <= {(1, 2, 3)}


def test_resampling_without_rows(spark, no_docs, docs):
    target = spark.createDataFrame([("a b",)], "text string")
    assert resampling.importance_report(no_docs, target).count() == 0
    assert resampling.resampled(no_docs, target).columns == no_docs.columns
    assert resampling.resampled(no_docs, target).count() == 0
    assert resampling.importance_report(docs, target.limit(0)).count() == len(TEXTS)


def test_runs_are_chained():
    words = resampling.words_of("One, TWO three".encode())
    assert [list(map(hex, run)) for run in resampling.longer_runs(words, 3)] == [
        [hex(zlib.crc32(b"one two")), hex(zlib.crc32(b"two three"))], [hex(zlib.crc32(b"one two three"))]]


NAN, INF = float("nan"), float("inf")
ODD = [(None, None), (3, []), (4, [NAN] * 4), (5, [1.0, None, 1.0, 1.0]), (6, [INF, 0.0, 0.0, 0.0]), (7, [0.0] * 4)]


def _vectors(seed, n, width, ids, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    return [(int(i), [float(x) for x in centres[k % 5] + spread * rng.normal(size=width)])
            for k, i in zip(range(n), ids, strict=False)]


def _codes(rows, parts, entries, rounds, scale=4096):
    """Brute force with Python's integers."""
    kept = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for *_, v in kept), default=0) // parts)
    cut = [[(v + [0] * (width * parts - len(v)))[p * width:(p + 1) * width] for p in range(parts)] for *_, v in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][2]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[near(c[p], books[p])[1]].append(c[p])
            for k, group in groups.items():
                books[p][k] = [sum(z) // len(group) for z in zip(*group, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    out, sums = [], Counter()
    for (i, label, _), c in zip(kept, cut, strict=True):
        found = [near(c[p], books[p]) for p in range(parts)]
        error = min(sum(d for d, _ in found), vector_codes.LONG)
        sums[label] += error
        out.append([i, "".join(f"{k:02x}" for _, k in found), error, label])
    return Counter((i, code, error, min(sums[label], vector_codes.LONG), digest) for i, code, error, label in out)


@pytest.mark.parametrize("parts,entries,width", [(8, 16, 64), (2, 80, 6), (3, 4, 7)])
def test_product_codes_are_brute_force(spark, parts, entries, width):
    ids = [*range(200, 100, -1), *range(150, 100, -1), *range(1000, 1100)]
    rows = [(i, k % 4 if k % 4 else None, v) for k, (i, v) in enumerate(_vectors(parts, 240, width, ids, 0.2))]
    rows += [(i, 1, v) for i, v in ODD] + [(None, 2, rows[0][2]), rows[1], rows[1], (5, 2, [-0.5])]
    df = stored(spark, [(*r, "x", 0) for r in rows], "vec_id long, label int, embedding array<double>, code string, v int")
    got = vector_codes.product_codes(df, parts=parts, entries=entries)
    assert Counter(tuple(r) for r in got.collect()) == _codes(rows, parts, entries, 6)


def test_product_codes_of_few_or_huge_or_no_vectors(spark):
    schema = "vec_id long, label int, embedding array<double>"
    empty = spark.createDataFrame([], schema)
    assert vector_codes.product_codes(empty).count() == 0
    rows = [(1, None, []), (2, 1, [])]
    got = vector_codes.product_codes(stored(spark, rows, schema))
    assert Counter(tuple(r) for r in got.collect()) == _codes(rows, 8, 16, 6)
    rows = [(i, 1, [1e9 * i, -3e8, 0.25]) for i in range(3)] + [(4, 1, [2.0 ** 40] * 9)]
    got = vector_codes.product_codes(stored(spark, rows, schema), entries=2)
    assert Counter(tuple(r) for r in got.collect()) == _codes(rows, 8, 2, 6)
    assert vector_codes.product_codes(stored(spark, [(1, 1, [1e300, -1e300])], schema)).first().error == 0


def test_masks_leave_few_entries_and_the_nearest():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, size=(64, 8))
    x = centres[rng.integers(0, 64, 5000)] + rng.integers(-300, 300, size=(5000, 8))
    chosen, least, computed = vector_codes.nearest_entries(x, centres)
    every = ((x[:, None] - centres[None]) ** 2).sum(2)
    assert (chosen == every.argmin(1)).all() and (least == every.min(1)).all()
    assert computed < 0.05 * every.size
    index = vector_codes.MaskIndex(centres)
    radius = rng.integers(1, 4000, 5000)
    box = (np.abs(x[:, None] - centres[None]) <= radius[:, None, None]).all(2)
    masks = index.within(x, radius)
    assert (box == (masks[:, None] >> np.arange(64, dtype=np.uint64) & np.uint64(1)).astype(bool)).all()


def _nearest(rows, k=5, every=50):
    kept = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    width = max((len(v) for _, v in kept), default=0)
    full = [[*v, *[0.0] * (width - len(v))] for _, v in kept]

    def dot(a, b):
        total = 0.0
        for x, y in zip(a, b, strict=True):
            total += x * y
        return total

    norms = [math.sqrt(dot(v, v)) for v in full]
    out = []
    for q, (query, _) in enumerate(kept):
        if query is None or query % every:
            continue
        scores = [(-(dot(full[q], full[c]) / (norms[q] * norms[c])), i is None, i or 0, i) for c, (i, _) in enumerate(kept)
                  if c != q]
        out += [(query, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("spread,query_rows,slice_rows", [(1.0, 2048, 8192), (1.0, 3, 20), (0.001, 3, 20)])
def test_nearest_is_brute_force(spark, spread, query_rows, slice_rows):
    ids = [*range(0, 300), *range(0, 300, 50)]
    rows = _vectors(7, 306, 12, ids, spread) + ODD + [(None, [1.0, 2.0]), (400, [3.0])]
    rows += [(450, [0.1, 0.7, -0.3])] * 2 + [(500 + i, [0.1, 0.7, -0.3]) for i in range(60)]
    df = stored(spark, [(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, row int, score double")
    got = nearest.nearest(df, query_rows=query_rows, slice_rows=slice_rows)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()), key=str) == _nearest(rows)


def test_nearest_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<double>"
    assert nearest.nearest(spark.createDataFrame([], schema)).count() == 0
    assert nearest.nearest(stored(spark, [(0, [1.0])], schema)).count() == 0
    rows = [(0, [1e300, 1e300]), (1, [1e-300, 1e-300]), (2, [-1e300, 0.0]), (3, [5e-324, 0.0])]
    got = [(r.vec_id, round(r.score, 12)) for r in nearest.nearest(stored(spark, rows, schema)).orderBy("rank").collect()]
    assert got == [(1, 1.0), (3, round(math.sqrt(0.5), 12)), (2, round(-math.sqrt(0.5), 12))]


def test_tiles_bound_cosines_and_drop_pairs():
    rng = np.random.default_rng(5)
    x = nearest.unit_vectors(rng.normal(size=(300, 1100)))
    code, scale, rest = nearest.int8_codes(x)
    products = nearest.tile_products(code, code)
    assert (products == code.astype(np.int64) @ code.astype(np.int64).T).all()
    error = rest[:, None] * np.sqrt((code.astype(float) ** 2).sum(1)) * scale + rest
    assert (np.abs(x @ x.T - products * scale[:, None] * scale) <= error + 1e-12).all()
    y = nearest.unit_vectors(rng.normal(size=(3000, 32)))
    coded = nearest.int8_codes(y)
    queries = tuple(c[:20] for c in coded)
    left = [len(v) for v in nearest.cell_survivors(np.full(20, -np.inf), queries, coded, np.arange(20), 5)]
    assert min(left) >= 5 and sum(left) < 0.02 * 20 * 3000
