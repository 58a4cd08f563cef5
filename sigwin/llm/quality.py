"""Operator 4: quality classifier on random-indexing word vectors.

Every word (hashed to one of ``VOCABULARY`` rows) has a fixed sparse random index
vector; its word vector is the sum of the index vectors of its neighbours over all
documents.  A document's word vectors are pooled: their mean, their deviation, and the
mean product of neighbouring vectors, each by component.  A two-layer numpy network with
a temperature fitted on labelled rows it was not trained on gives the probability of
label 1.  Nothing but the pooled vectors is an input.

The word vectors cover all documents; their matrix has a fixed size (1 MiB).  The
network is fitted on the driver from at most ``MAX_LABELLED`` labelled rows, chosen by
a hash of doc_id, whose pooled vectors are ``3 * WIDTH`` numbers each.

Defined results: null texts are empty texts; empty texts are scored like any other
(all inputs zero); rows with a null doc_id are scored and not held out; repeated
rows get equal scores; with no usable label the score is 0.5, with labels of one
class it is near that class's rate; an empty table gives no rows; other columns,
whatever their names, are not read, and ``good_documents`` returns them as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigwin.llm.chunks import SortedChunkTable, bounds
from sigwin.llm.common import added_up, arrow_schema, fresh_names, slices, task_batch

VOCABULARY = 8192
WIDTH = 32
NONZERO = 4
WINDOW = 2
ROWS_OF_CHUNK = 512
#: The bound of the labelled sample.
MAX_LABELLED = 20_000
HIDDEN = 32
EPOCHS = 60
SEED = 7
THRESHOLD = 0.3
#: Chunks of text whose words a worker keeps, and how many of them stay when there are more.
CACHED, KEPT = 1_000_000, 500_000
#: Bytes of text that are split at a time.
AT_ONCE = 1 << 20
WORD = re.compile(r"\w+|[^\w\s]+")
SPACE, SIGN, LETTER = (np.isin(np.arange(256), list(x)) for x in (
    b" \t\n\r", b"!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~", b"_0123456789" + bytes(range(65, 91)) + bytes(range(97, 123))))


def index_vectors() -> np.ndarray:
    """One sparse vector of +1 and -1 for each row of the vocabulary, and one of zeros: no word."""
    rng = np.random.default_rng(SEED)
    at = np.argsort(rng.random((VOCABULARY, WIDTH)), axis=1)[:, :NONZERO]
    out = np.zeros((VOCABULARY + 1, WIDTH), dtype=np.int8)
    np.put_along_axis(out[:-1], at, rng.choice(np.array([-1, 1], dtype=np.int8), at.shape), axis=1)
    return out


def _words(chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The vocabulary rows of the words of chunks, and how many each chunk has."""
    found = [[crc32(w.encode("utf-8", "replace")) % VOCABULARY for w in WORD.findall(c)] for c in chunks]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter((r for rows in found for r in rows), "<u4", sizes.sum()), sizes


@lru_cache(1)
def _table() -> SortedChunkTable:
    return SortedChunkTable()


def word_rows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vocabulary rows of the words of all texts, and how many words each has, about ``AT_ONCE`` bytes at a
    time.  A text is cut at white space and between ASCII letters and signs, where words end anyway; each
    distinct chunk is split once."""
    table, held, size = _table(), [], 0
    for i, text in enumerate(texts):
        held.append(text)
        size += len(text)
        if size < AT_ONCE and i + 1 < len(texts):
            continue
        if len(table) > CACHED:
            table.keep(KEPT)
        data = b" " + b" ".join(held) + b" "
        raw = np.frombuffer(data, np.uint8)
        cut = np.zeros(len(raw), bool)
        sign, letter = SIGN[raw], LETTER[raw]
        cut[1:] = (sign[1:] & letter[:-1]) | (letter[1:] & sign[:-1])
        start, end = bounds(raw, SPACE[raw], cut)
        rows, upto = table.values(data, start, end, _words)
        begins = 1 + np.cumsum([0] + [len(t) + 1 for t in held])
        yield rows.astype(np.uint16), np.diff(np.r_[0, upto][np.searchsorted(start, begins)])
        held, size = [], 0


def neighbour_sums(rows: np.ndarray, sizes: np.ndarray, index: np.ndarray, into: np.ndarray) -> None:
    """Add to ``into`` the index vectors of each word's neighbours in its text."""
    if not len(rows):
        return
    # Between texts are places without a word, so that no window reaches another text.
    gaps = np.repeat(np.arange(len(sizes)), sizes) * WINDOW + np.arange(len(rows)) + WINDOW
    vectors = np.zeros((len(rows) + WINDOW * (len(sizes) + 1), WIDTH), np.int8)
    vectors[gaps] = index[rows]
    near = np.zeros_like(vectors)
    for shift in range(1, WINDOW + 1):
        near[shift:] += vectors[:-shift]
        near[:-shift] += vectors[shift:]
    order = np.argsort(rows, kind="stable")
    word = rows[order]
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    into[word[first]] += np.add.reduceat(near[gaps[order]], first, axis=0, dtype=np.int32)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The vectors of all words over all documents, centred and of length 1.

    Each task sums its own matrix and the matrices are added up by chunks of rows in two
    streamed steps, so the shuffle is one matrix a task and the driver gets one matrix.
    """
    schema = "chunk int, batch int, sums binary"
    arrow = arrow_schema(schema)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sums = index_vectors(), np.zeros((VOCABULARY, WIDTH), dtype=np.int32)
        for batch in slices(batches):
            for rows, sizes in word_rows(_texts(batch.column(0))):
                neighbour_sums(rows, sizes, index, sums)
        for k in range(0, VOCABULARY, ROWS_OF_CHUNK):
            part = sums[k:k + ROWS_OF_CHUNK]
            if part.any():
                yield pa.RecordBatch.from_pydict({"chunk": [k], "batch": [task_batch()],
                                                  "sums": [part.astype(np.int64).tobytes()]}, schema=arrow)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chunk = np.zeros(ROWS_OF_CHUNK * WIDTH, np.int64), 0
        for b in batches:
            for k, part in zip(b["chunk"], b["sums"], strict=True):
                chunk = k.as_py()
                total += np.frombuffer(part.as_py(), np.int64)
        yield pa.RecordBatch.from_pydict({"chunk": [chunk], "batch": [0], "sums": [total.tobytes()]}, schema=arrow)

    sums = added_up(docs.select(F.col("text").cast("string")).mapInArrow(partial, schema), schema, add)
    out = np.zeros((VOCABULARY, WIDTH))
    for row in sums.toLocalIterator():
        out[row["chunk"]:row["chunk"] + ROWS_OF_CHUNK] = np.frombuffer(row["sums"], np.int64).reshape(-1, WIDTH)
    out = np.sign(out) * np.log1p(np.abs(out))
    used = out.any(1)
    if used.any():
        out[used] -= out[used].mean(0)
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """A row of ``3 * WIDTH`` inputs for each text: mean, deviation and neighbours' mean product."""
    out, text = np.zeros((len(texts), 3 * vectors.shape[1])), 0
    for rows, sizes in word_rows(texts):
        every, end = vectors[rows], 0
        for n in sizes.tolist():
            if n:
                v, one = every[end:end + n].astype(np.float64), np.ones(n)
                mean, square, near = one @ v / n, one @ (v * v) / n, one[1:] @ (v[1:] * v[:-1]) / n
                out[text] = np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0)), near])
            text, end = text + 1, end + n
    return out


@dataclass(frozen=True)
class Network:
    """Two layers, the scaling of the inputs, and the temperature of the output."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """Adam on four fifths of the rows; the temperature is the best of a grid on the other fifth."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    if not len(y):
        return Network(np.zeros(d), np.ones(d), np.zeros((d, 1)), np.zeros(1), np.zeros(1), 0.0)
    aside = np.arange(len(y)) % 5 == 4
    train = np.flatnonzero(~aside)
    mean, scale = x[train].mean(0), np.maximum(x[train].std(0), 1e-3)
    u = (x - mean) / scale
    # The prior is taken one row towards even, so that one class alone gives a finite value.
    rate = (y[train].sum() + 1) / (len(train) + 2)
    p = [rng.normal(0, 1 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.1, HIDDEN),
         np.array(np.log(rate / (1 - rate)))]
    first, second, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs if len(np.unique(y[train])) > 1 else 0):
        for at in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
            h = np.tanh(u[at] @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -40, 40))) - y[at]) / len(at)
            back = np.outer(g, p[2]) * (1 - h * h)
            grads = [u[at].T @ back + 1e-4 * p[0], back.sum(0), h.T @ g + 1e-4 * p[2], g.sum()]
            step += 1
            for k, grad in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * grad
                second[k] = 0.999 * second[k] + 0.001 * grad * grad
                p[k] = p[k] - 0.003 * (first[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    if not step:
        p[2] = np.zeros(HIDDEN)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3]))
    if not aside.any() or not step:
        return net
    z = net.logits(x[aside])
    best = min(np.geomspace(0.5, 4, 25), key=lambda t: _loss(z / t, y[aside]))
    return Network(mean, scale, p[0], p[1], p[2], float(p[3]), float(best))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Whether crc32 of doc_id as text is divisible by 5; a null doc_id is not held out."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass(frozen=True)
class Classifier:
    vectors: np.ndarray
    network: Network

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities to nine places: the last ones depend on which texts are scored together."""
        return np.round(self.network.scores(pooled(texts, self.vectors)), 9)


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Classifier:
    """Word vectors from all ``docs``, network from labelled rows that are not held out."""
    vectors = word_vectors(docs)
    usable = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    # At most max_labelled pairs of numbers: safe to broadcast.
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            if b.num_rows:
                x = pooled(_texts(b.column(2)), vectors).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1),
                                                  pa.array([v.tobytes() for v in x], pa.binary())],
                                                 names=["doc_id", "quality", "x"])

    got = (rows.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"), F.col("text").cast("string"))
           .mapInArrow(inputs, "doc_id long, quality int, x binary")
           .groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("x").alias("x"))
           .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).collect())
    x = np.array([np.frombuffer(r["x"], np.float32) for r in got], dtype=float).reshape(len(got), 3 * WIDTH)
    return Classifier(vectors, fit_network(x, np.array([r["quality"] for r in got], dtype=float)))


def with_score(docs: DataFrame, classifier: Classifier, column: str) -> DataFrame:
    """``docs`` with the score of its text appended."""
    fields = [*docs.schema.fields, T.StructField(column, T.DoubleType())]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            scores = classifier.scores(_texts(b.column(at)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[f.name for f in fields])

    return docs.mapInArrow(run, T.StructType(fields))


def score_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    docs = docs.select("doc_id", "text")
    scored = with_score(docs, fit(docs, labels, **options), "score")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject."""
    score, = fresh_names(docs.columns, "score")
    return with_score(docs, fit(docs, labels, **options), score).where(F.col(score) >= THRESHOLD).drop(score)
