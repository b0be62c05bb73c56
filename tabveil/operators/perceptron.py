"""Spark's multilayer perceptron, fitted in whole arrays: the same start, loss, solver and stopping rule, and Spark's model in the end."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import pairwise

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block: its hidden layer stays in a core's cache.
BLOCK = 1024


def matrices(w: np.ndarray, layers: Sequence[int]) -> list[np.ndarray]:
    """Views of Spark's flat weights: for each layer a row for each input and one for the bias."""
    ends = np.cumsum([(a + 1) * b for a, b in pairwise(layers)])
    return [part.reshape(a + 1, b) for part, (a, b) in zip(np.split(w, ends[:-1]), pairwise(layers), strict=True)]


def loss(x: np.ndarray, y: np.ndarray, w: np.ndarray, layers: Sequence[int]) -> tuple[float, np.ndarray]:
    """Sums over a block's rows: cross entropy of the softmax, and its gradient; `x` has a column for each row, and a last row of ones."""
    ms = matrices(w, layers)
    ins = [x]
    for k, m in enumerate(ms[:-1]):
        z = m.T @ x if k == 0 else m[:-1].T @ ins[-1] + m[-1][:, None]
        np.negative(z, out=z)
        with np.errstate(over="ignore"):
            np.exp(z, out=z)
        z += 1
        ins.append(np.reciprocal(z, out=z))
    out = ms[-1].T @ x if len(ms) == 1 else ms[-1][:-1].T @ ins[-1] + ms[-1][-1][:, None]
    out -= out.max(0)
    at = np.arange(len(y))
    total = -out[y, at].sum()
    np.exp(out, out=out)
    sums = out.sum(0)
    total += np.log(sums).sum()
    out /= sums
    out[y, at] -= 1
    grads = []
    for k in range(len(ms) - 1, -1, -1):
        grads.append((ins[k] @ out.T).ravel() if k == 0 else np.concatenate([(ins[k] @ out.T).ravel(), out.sum(1)]))
        if k:
            h = ins[k]
            out = ms[k][:-1] @ out
            out *= h
            out *= np.subtract(1, h, out=h)
    return float(total), np.concatenate(grads[::-1])


def packed(df: DataFrame, features: str, label: str, parts: int):
    """An RDD of (a column for each row, ending in 1; labels), a block each, dealt evenly to `parts` tasks."""

    def pack(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            y = batch.column(1).to_numpy()
            x = np.asarray(batch.column(0).flatten()).reshape(len(y), -1)
            x = np.vstack([x.T, np.ones(len(y))])
            cuts = range(0, len(y), BLOCK)
            yield pa.RecordBatch.from_pydict({"x": [x[:, i : i + BLOCK].tobytes() for i in cuts], "y": [y[i : i + BLOCK].tobytes() for i in cuts]}, pa.schema([("x", pa.binary()), ("y", pa.binary())]))

    def unpack(row) -> tuple[np.ndarray, np.ndarray]:
        y = np.frombuffer(row["y"], np.int32)
        return np.frombuffer(row["x"]).reshape(-1, len(y)), y

    rows = df.select(vector_to_array(features), F.col(label).cast("int")).repartition(parts)
    return rows.mapInArrow(pack, "x binary, y binary").rdd.map(unpack)


def wolfe(f: Callable, value: float, slope: float, first: float, tries: int = 20) -> tuple[float, float, np.ndarray] | None:
    """A step that fulfils the strong Wolfe conditions, or the best that lowers the value; f gives value, slope and gradient at a step."""
    low, high, last = (0.0, value, slope), None, None
    step, best = first, None
    for _ in range(tries):
        v, s, g = f(step)
        good = np.isfinite(v) and v <= value + 1e-4 * step * slope
        if good and abs(s) <= 0.9 * abs(slope):
            return step, v, g
        if good and (best is None or v < best[1]):
            best = step, v, g
        if not good or v >= low[1] and low[0] > 0:
            high = (step, v, s)
        elif s >= 0:
            low, high = (step, v, s), low
        else:
            low, last = (step, v, s), low
        if high is None:
            step = low[0] + 4 * (low[0] - last[0])
            continue
        # the least of the cubic through both ends, kept away from them
        (a, va, sa), (b, vb, sb) = low, high
        step = (a + b) / 2
        if np.isfinite(vb):
            d = sa + sb - 3 * (va - vb) / (a - b)
            root = d * d - sa * sb
            if root >= 0:
                r = np.sign(b - a) * np.sqrt(root)
                if (under := sb - sa + 2 * r) != 0:
                    step = b - (b - a) * (sb + r - d) / under
        margin = 0.1 * abs(b - a)
        step = min(max(step, min(a, b) + margin), max(a, b) - margin)
    return best


def lbfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, tol: float, memory: int = 10, history: int = 20) -> tuple[np.ndarray, list[float]]:
    """The least of f and the values on the way, with the stopping rule of Spark's solver.

    It ends after `rounds`, when `history` rounds lower f by at most `tol` of its first value, or when the gradient is small.
    """
    value, grad = f(x)
    values, pairs, failed = [value], [], False
    while len(values) <= rounds and np.linalg.norm(grad) > max(tol * abs(value), 1e-8):
        if len(values) > 1 and abs(value - max(values[-history:])) <= tol * abs(values[0]):
            break
        d, kept = -grad, []
        for s, t, r in reversed(pairs):
            a = r * (s @ d)
            kept.append(a)
            d = d - a * t
        if pairs:
            d = d * (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1])
        for (s, t, r), a in zip(pairs, reversed(kept), strict=True):
            d = d + (a - r * (t @ d)) * s

        def along(step: float, x=x, d=d):
            v, g = f(x + step * d)
            return v, float(g @ d), g

        found = wolfe(along, value, float(grad @ d), 1.0 if pairs else 1.0 / np.linalg.norm(d))
        if found is None:
            if failed or not pairs:
                break
            failed, pairs = True, []
            continue
        failed = False
        step, value, new = found
        s, t = step * d, new - grad
        if s @ t > 0:
            pairs = [*pairs, (s, t, 1 / (s @ t))][-memory:]
        x, grad = x + s, new
        values.append(value)
    return x, values


class Perceptron(MultilayerPerceptronClassifier):
    """MultilayerPerceptronClassifier whose L-BFGS sums loss and gradient over packed blocks, on all cores.

    `values` of the fitted model are the mean losses of all rounds; its `summary` knows one row only.
    """

    def _fit(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        if self.getSolver() != "l-bfgs":
            return super()._fit(dataset)
        layers, context = list(self.getLayers()), dataset.sparkSession.sparkContext
        blocks = packed(dataset, self.getFeaturesCol(), self.getLabelCol(), context.defaultParallelism).persist(StorageLevel.MEMORY_AND_DISK)
        one = dataset.sparkSession.createDataFrame([(Vectors.dense([0.0] * layers[0]), 0.0)], [self.getFeaturesCol(), self.getLabelCol()])
        start = self.copy({self.maxIter: 0})._fit_spark(one)

        def mean(w: np.ndarray) -> tuple[float, np.ndarray]:
            def part(rows) -> Iterator[tuple]:
                n, total, grad = 0, 0.0, np.zeros(len(w))
                for x, y in rows:
                    v, g = loss(x, y, w, layers)
                    n, total, grad = n + len(y), total + v, grad + g
                yield n, total, grad

            n, total, grad = (sum(p) for p in zip(*blocks.mapPartitions(part).collect(), strict=True))  # a row a task
            return total / n, grad / n

        try:
            w, values = lbfgs(mean, start.weights.toArray(), self.getMaxIter(), self.getTol())
        finally:
            blocks.unpersist()
        model = self.copy({self.maxIter: 0, self.initialWeights: Vectors.dense(w)})._fit_spark(one)
        model = self._copyValues(model)
        model.values = values
        return model

    def _fit_spark(self, dataset: DataFrame) -> MultilayerPerceptronClassificationModel:
        return super()._fit(dataset)
