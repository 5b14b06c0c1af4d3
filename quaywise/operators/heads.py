"""Heads over grids of tokens: attention pooling or a small convolution, then a linear output.

A row's vector is a grid of rows * columns tokens with as many channels each, token by token.
A fit deals its rows to blocks once, which Spark caches; each step of Adam is a job that reads
the blocks one by one and sums their gradients, so a task's memory doesn't grow with its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, which a task holds at once.
BLOCK = 1024


def adam(w: np.ndarray, gradient, steps: int, rate: float) -> np.ndarray:  # noqa: ANN001
    """Weights after so many steps down ``gradient(w)``, at a falling rate."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w = w - rate * (1 - 0.9 * t / steps) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def fitted_in_blocks(rows: DataFrame, held, gradient, start: np.ndarray, steps: int, rate: float, workers: int | None) -> np.ndarray:  # noqa: ANN001
    """Weights from one job a step: ``held(batches)`` makes a block's data, ``gradient(data, w)`` its (gradient sum, rows).

    Blocks of ``BLOCK`` rows are cached by Spark as bytes, in ``workers`` partitions if given; a
    task holds one of them at a time, however many rows there are.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, b.schema) as out:
                    out.write_batch(b.slice(at, BLOCK))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block"])

    blocks = (rows.repartition(workers) if workers else rows).mapInArrow(packed, "block binary").persist(StorageLevel.DISK_ONLY)

    def whole(w: np.ndarray) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(w) + 1)
            for b in batches:
                for block in b.column(0):
                    g, n = gradient(held(pa.ipc.open_stream(block.as_buffer())), w)
                    total += np.append(g, n)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tolist()], pa.list_(pa.float64()))], ["part", "sums"])

        parts = sorted(blocks.mapInArrow(run, "part long, sums array<double>").collect())  # a row a partition
        total = np.sum([r.sums for r in parts], axis=0) if parts else np.zeros(len(w) + 1)
        return total[:-1] / max(total[-1], 1.0)

    try:
        return adam(start, whole, steps, rate)
    finally:
        blocks.unpersist()


@dataclass
class SpatialHead:
    """``kind``: attention (softmax weights over tokens from a learned query, per head) or convolution (3 x 3 filters, tanh, mean).

    ``units`` heads or filters. Squared error on standardised targets; channels are standardised
    over all tokens of the training rows.
    """

    vector: str
    grid: tuple[int, int]
    kind: str = "attention"
    units: int = 2
    steps: int = 60
    rate: float = 0.05
    seed: int = 7
    workers: int | None = None
    weights: np.ndarray | None = field(default=None, repr=False)

    def _shapes(self) -> list[tuple[int, ...]]:
        c, u = self.channels, self.units
        return [(u, c), (u, c), ()] if self.kind == "attention" else [(u, 9, c), (u,), (u,), ()]

    def _split(self, w: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for shape in self._shapes():
            n = int(np.prod(shape))
            out.append(w[at : at + n].reshape(shape))
            at += n
        return out

    def _patches(self, x: np.ndarray) -> np.ndarray:
        """(rows, tokens, 9, channels): each token's neighbourhood, zero beyond the edges."""
        h, wide = self.grid
        g = np.pad(x.reshape(len(x), h, wide, -1), ((0, 0), (1, 1), (1, 1), (0, 0)))
        return np.stack([g[:, i : i + h, j : j + wide] for i in range(3) for j in range(3)], axis=3).reshape(len(x), h * wide, 9, x.shape[-1])

    def output(self, x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, tuple]:
        """(predictions, what the gradient needs) of tokens (rows, tokens, channels)."""
        if self.kind == "attention":
            query, out, bias = self._split(w)
            s = np.einsum("ntc,uc->nut", x, query)
            a = np.exp(s - s.max(axis=2, keepdims=True))
            a /= a.sum(axis=2, keepdims=True)
            pooled = np.einsum("nut,ntc->nuc", a, x)
            return np.einsum("nuc,uc->n", pooled, out) + bias, (a, pooled)
        kernel, shift, out, bias = self._split(w)
        p = self._patches(x)
        h = np.tanh(np.einsum("ntkc,ukc->nut", p, kernel) + shift[None, :, None])
        return h.mean(axis=2) @ out + bias, (p, h)

    def gradient(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Summed derivative of half the squared error by the weights."""
        found, kept = self.output(x, w)
        e = found - y
        if self.kind == "attention":
            query, out, _ = self._split(w)
            a, pooled = kept
            value = np.einsum("ntc,uc->nut", x, out)
            by_score = a * (value - (a * value).sum(axis=2, keepdims=True)) * e[:, None, None]
            return np.concatenate([np.einsum("nut,ntc->uc", by_score, x).ravel(), np.einsum("n,nuc->uc", e, pooled).ravel(), [e.sum()]])
        _, _, out, _ = self._split(w)
        p, h = kept
        by_unit = (1 - h * h) * out[None, :, None] * e[:, None, None] / h.shape[2]
        return np.concatenate([np.einsum("nut,ntkc->ukc", by_unit, p).ravel(), by_unit.sum(axis=(0, 2)), h.mean(axis=2).T @ e, [e.sum()]])

    def fit(self, train: DataFrame, y: str = "y") -> SpatialHead:
        """Rows without a target or a vector are left out."""
        tokens = self.grid[0] * self.grid[1]
        # single precision stays as it is until a block is read
        kind = "array<float>" if train.schema[self.vector].dataType.simpleString() == "array<float>" else "array<double>"
        rows = train.select(F.col(self.vector).cast(kind).alias("v"), F.col(y).cast("double").alias("y")).dropna()
        size = rows.select(F.max(F.size("v"))).head()[0]
        if not size or size % tokens:
            raise ValueError(f"vectors of {size} numbers are no grid of {tokens} tokens")
        self.channels = size // tokens
        each = rows.select(F.posexplode("v").alias("i", "x")).groupBy((F.col("i") % self.channels).alias("c")).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()  # a row a channel
        self.mean, self.sd = np.zeros(self.channels), np.ones(self.channels)
        for r in each:
            self.mean[r.c], self.sd[r.c] = r.m, r.s or 1.0
        m, s = rows.agg(F.avg("y"), F.stddev_pop("y")).head()
        self.centre, self.spread = m, s or 1.0
        rng = np.random.default_rng(self.seed)
        start = np.concatenate([rng.normal(0, 0.3, shape).ravel() for shape in self._shapes()])
        own = self

        def held(batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
            x, y_ = [np.zeros((0, tokens, own.channels))], [np.zeros(0)]
            for b in batches:
                x.append(own._tokens(b.column(0)))
                y_.append((b.column(1).to_numpy(zero_copy_only=False) - own.centre) / own.spread)
            return np.concatenate(x), np.concatenate(y_)

        self.weights = fitted_in_blocks(rows, held, lambda d, w: (own.gradient(*d, w), len(d[1])), start, self.steps, self.rate, self.workers)
        return self

    def _tokens(self, column: pa.Array) -> np.ndarray:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
        return (flat.reshape(len(column), self.grid[0] * self.grid[1], self.channels) - self.mean) / self.sd

    def predict(self, df: DataFrame, name: str = "yhat") -> DataFrame:
        """Adds the prediction; null where the vector is."""
        own = self

        @F.pandas_udf("double")
        def value(v: pd.Series) -> pd.Series:
            there = v.notna().to_numpy()
            out = np.full(len(v), np.nan)
            if there.any():
                out[there] = own.output(own._tokens(pa.array(v[there].tolist(), pa.list_(pa.float64()))), own.weights)[0] * own.spread + own.centre
            return pd.Series(out)

        found = df.withColumn(name, value(F.col(self.vector).cast("array<double>")))
        return found.withColumn(name, F.when(~F.isnan(name), F.col(name)))
