"""A ReLU network under focal loss, trained by full passes over distributed blocks.

The training rows are stored once as blocks of features (``ROWS`` rows each).  A round is
one job: every task sums the loss, its gradient and the scores' histograms over its
blocks, and the sums are added up in groups of tasks until one is left: the driver gets one
parameter-sized vector a round, however many rows and tasks there are, and no row.  The driver keeps the
parameters (their number is fixed by the layers) and steps by L-BFGS.  Each round
also gives loss, ROC AUC and average precision of the training and the validation rows;
the scores are counted in ``BINS`` equal bins for the latter two, with ties as halves.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigwin.session import stored

#: Rows of a block, bins of the scores, tasks whose sums are added up together.
ROWS, BINS, SUMMED = 4096, 4096, 64
#: A training loss below this ends the training.
ENOUGH = 1e-5
#: Splits of the rows, by their number in the statistics.
SPLITS = ("train", "valid")


@dataclass(frozen=True)
class Network:
    """Layer sizes and all weights and biases, one after the other, as one vector."""

    layers: tuple[int, ...]
    weights: np.ndarray

    @staticmethod
    def start(layers: tuple[int, ...], seed: int) -> Network:
        """Normal weights of variance 2 / inputs, zero biases."""
        rng = np.random.default_rng(seed)
        parts = []
        for a, b in zip(layers, layers[1:], strict=False):
            parts += [rng.normal(0, np.sqrt(2 / a), a * b), np.zeros(b)]
        return Network(tuple(layers), np.concatenate(parts))

    def matrices(self) -> list[tuple[np.ndarray, np.ndarray]]:
        out, at = [], 0
        for a, b in zip(self.layers, self.layers[1:], strict=False):
            out.append((self.weights[at:at + a * b].reshape(a, b), self.weights[at + a * b:at + a * b + b]))
            at += a * b + b
        return out

    def forward(self, x: np.ndarray) -> list[np.ndarray]:
        """The inputs of every layer, and the logits of the two classes last."""
        steps = self.matrices()
        values = [x]
        for i, (w, b) in enumerate(steps):
            z = values[-1] @ w + b
            values.append(z if i + 1 == len(steps) else np.maximum(z, 0))
        return values

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        z = self.forward(x)[-1]
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -700, 700)))

    def loss_and_gradient(self, x: np.ndarray, y: np.ndarray, alpha: float, gamma: float
                          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Focal losses of the rows, the gradient of their sum, and the probabilities of class 1."""
        values = self.forward(x)
        z = values[-1]
        margin = np.where(y == 1, z[:, 1] - z[:, 0], z[:, 0] - z[:, 1])
        ce = np.logaddexp(0, -margin)
        true = np.exp(-ce)
        rest = -np.expm1(-ce)
        losses = alpha * rest ** gamma * ce
        slope = alpha * (-gamma * rest ** gamma * true * ce - rest ** (gamma + 1))
        back = np.where((y == 1)[:, None], slope[:, None] * [-1, 1], slope[:, None] * [1, -1])
        steps, grads = self.matrices(), []
        for i in range(len(steps) - 1, -1, -1):
            grads.append((values[i].T @ back, back.sum(0)))
            if i:
                back = (back @ steps[i][0].T) * (values[i] > 0)
        flat = [part.ravel() for w, b in reversed(grads) for part in (w, b)]
        return losses, np.concatenate(flat), np.where(y == 1, true, rest)


def feature_blocks(rows: DataFrame) -> DataFrame:
    """Stored ``(n, x, y, valid)``: the rows ``(x array<double>, label, valid)`` in binary blocks."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = part.column(0).flatten().to_numpy(zero_copy_only=False).astype("<f8")
                y, valid = (part.column(i).cast(pa.int8()).to_numpy(zero_copy_only=False) for i in (1, 2))
                yield pa.RecordBatch.from_pydict({
                    "n": pa.array([part.num_rows], pa.int32()),
                    **{k: pa.array([v.tobytes()], pa.binary()) for k, v in (("x", x), ("y", y), ("valid", valid))}})

    packed = rows.select("x", F.col("label").cast("int"), F.col("valid").cast("int"))
    return stored(packed.mapInArrow(pack, "n int, x binary, y binary, valid binary"), "feature-blocks")


def _statistics_size() -> int:
    """Rows and loss of both splits, and the bins of both classes in both."""
    return 4 + 4 * BINS


def summed_blocks(blocks: DataFrame, tasks: int, network: Network, alpha: float, gamma: float) -> DataFrame:
    """``(batch, sums)``: one row with the gradient and the statistics over all blocks.

    The sums of the tasks are added up in groups of ``SUMMED`` until one is left."""
    size, width = len(network.weights), network.layers[0]
    schema = "batch int, sums binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(size + _statistics_size())
        stats = sums[size:]
        for batch in batches:
            for x, y, valid in zip(*(batch.column(i) for i in (1, 2, 3)), strict=True):
                x = np.frombuffer(x.as_py(), "<f8").reshape(-1, width)
                y, valid = np.frombuffer(y.as_py(), np.int8), np.frombuffer(valid.as_py(), np.int8)
                for split in (0, 1):
                    own = valid == split
                    losses, gradient, p = network.loss_and_gradient(x[own], y[own], alpha, gamma)
                    if split == 0:
                        sums[:size] += gradient
                    stats[split], stats[2 + split] = stats[split] + own.sum(), stats[2 + split] + losses.sum()
                    at = np.minimum((p * BINS).astype(np.int64), BINS - 1) + BINS * (2 * split + (y[own] == 1))
                    stats[4:] += np.bincount(at, minlength=4 * BINS)
        batch = TaskContext.get().partitionId() // SUMMED
        yield pa.RecordBatch.from_pydict({"batch": pa.array([batch], pa.int32()),
                                          "sums": pa.array([sums.tobytes()], pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, number = np.zeros(size + _statistics_size()), 0
        for batch in batches:
            for number, part in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total += np.frombuffer(part.as_py())
        yield pa.RecordBatch.from_pydict({"batch": pa.array([number // SUMMED], pa.int32()),
                                          "sums": pa.array([total.tobytes()], pa.binary())})

    sums = blocks.mapInArrow(run, schema)
    while tasks > 1:
        tasks = -(-tasks // SUMMED)
        sums = sums.repartition(tasks, "batch").groupBy("batch").applyInArrow(add, schema)
    return sums


def round_sums(blocks: DataFrame, tasks: int, network: Network, alpha: float, gamma: float
               ) -> tuple[np.ndarray, np.ndarray]:
    """(gradient of the sum of the training losses, statistics): one job over all blocks."""
    size = len(network.weights)
    total = np.zeros(size + _statistics_size())
    for row in summed_blocks(blocks, tasks, network, alpha, gamma).collect():
        total += np.frombuffer(row["sums"])
    return total[:size], total[size:]


def split_metrics(stats: np.ndarray) -> list[tuple[str, int, float, float, float]]:
    """(split, n, loss, auc, ap) of both splits; one class alone has AUC 0, no positive row AP 0."""
    out = []
    for k, name in enumerate(SPLITS):
        fp, tp = stats[4:].reshape(4, BINS)[2 * k:2 * k + 2, ::-1]
        n, positives, negatives = stats[k], tp.sum(), fp.sum()
        above = np.cumsum(tp) - tp
        auc = float((fp * (above + tp / 2)).sum() / (positives * negatives)) if positives and negatives else 0.0
        seen = np.cumsum(tp) + np.cumsum(fp)
        precision = np.divide(np.cumsum(tp), seen, out=np.zeros(BINS), where=seen > 0)
        ap = float((tp * precision).sum() / positives) if positives else 0.0
        out.append((name, int(n), float(stats[2 + k] / n) if n else None, auc, ap))
    return out


def minimise(evaluate: Callable, w: np.ndarray, rounds: int, memory: int = 10) -> Iterator[tuple]:
    """L-BFGS with step halving.  ``evaluate(w)`` is a round and returns (loss, gradient, extra);
    yields ``(w, loss, extra)`` of every round that lowers the loss, the first one included."""
    loss, gradient, extra = evaluate(w)
    yield w, loss, extra
    pairs: deque = deque(maxlen=memory)
    left = rounds - 1
    while left > 0 and np.abs(gradient).max(initial=0) > 1e-9:
        direction, scales = -gradient, []
        for s, y in reversed(pairs):
            scales.append(s @ direction / (s @ y))
            direction = direction - scales[-1] * y
        if pairs:
            s, y = pairs[-1]
            direction = direction * (s @ y / (y @ y))
        for (s, y), scale in zip(pairs, reversed(scales), strict=True):
            direction = direction + s * (scale - y @ direction / (s @ y))
        step = 1.0 if pairs else min(1.0, 1 / np.abs(gradient).sum())
        slope = gradient @ direction
        if slope >= 0:
            pairs.clear()
            continue
        while left > 0:
            left -= 1
            near = w + step * direction
            found = evaluate(near)
            if found[0] <= loss + 1e-4 * step * slope:
                break
            step /= 2
            if step < 1e-10:
                return
        else:
            return
        s, y = near - w, found[1] - gradient
        if s @ y > 1e-12 * (y @ y):
            pairs.append((s, y))
        w, (loss, gradient, extra) = near, found
        yield w, loss, extra


@dataclass
class Training:
    network: Network
    #: (round, split, n, loss, auc, ap)
    history: list[tuple] = field(default_factory=list)


def fit_network(rows: DataFrame, layers: tuple[int, ...], alpha: float = 1.0, gamma: float = 2.0, rounds: int = 100,
                patience: int = 20, seed: int = 42) -> Training:
    """Train on ``(x, label, valid)`` rows.  Stops after ``patience`` accepted rounds without a lower
    validation loss (training loss, without validation rows), or when the training loss is below
    ``ENOUGH``, and returns the best weights."""
    blocks = feature_blocks(rows)
    start, tasks = Network.start(layers, seed), blocks.rdd.getNumPartitions()

    def evaluate(w: np.ndarray) -> tuple:
        gradient, stats = round_sums(blocks, tasks, Network(start.layers, w), alpha, gamma)
        n = max(1.0, stats[0])
        return stats[2] / n, gradient / n, split_metrics(stats)

    training, best, since = Training(start), np.inf, 0
    for i, (w, loss, metrics) in enumerate(minimise(evaluate, start.weights, rounds)):
        training.history += [(i, *m) for m in metrics]
        watched = metrics[1][2] if metrics[1][1] else loss
        if watched < best - 1e-6:
            best, since, training.network = watched, 0, Network(start.layers, w)
        else:
            since += 1
        if since >= patience or loss < ENOUGH:
            break
    return training


def with_probability(df: DataFrame, network: Network, x: str, name: str) -> DataFrame:
    """``df`` with the probability of class 1 from the feature array ``x`` in its place; narrow."""
    at = df.columns.index(x)
    fields = [f for f in df.schema.fields if f.name != x] + [T.StructField(name, T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(-1, network.layers[0])
            rest = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(network.probability(values), pa.float64())],
                                             [f.name for f in fields])

    return df.mapInArrow(run, T.StructType(fields))
