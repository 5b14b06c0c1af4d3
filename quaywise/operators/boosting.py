"""Gradient-boosted regression trees from histograms, with staged errors, early stopping and exact attributions.

Each feature is cut into bins once, at approximate quantiles of the training rows; nulls and
NaN have the lowest bin to themselves. A round of trees is one barrier job: every task holds
its rows as bins (a byte a feature) with their predictions, and at each level of a tree the
tasks sum up slopes and counts by (node, feature, bin), of left children only; the right ones
are what is left of their parents. All tasks see the same sums and so choose the same
splits; no row moves and no job starts while a round grows.

A lost task restarts its round, not the model: a round starts from the trees before it.
Memory of a task: rows / workers * (features + 32) bytes; what it exchanges a level is
nodes * features * bins * 16 bytes, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .together import Together

#: A node that isn't split sends all rows left: no bin is above this.
_ALL_LEFT = 255


def slope(loss: str, level: float, e: np.ndarray) -> np.ndarray:
    """Derivative of the loss by the prediction; e: prediction less target."""
    if loss == "squared":
        return e
    if loss == "huber":
        return np.clip(e, -level, level)
    above = 0.5 if loss == "absolute" else level
    return np.where(e > 0, 1 - above, -above)


def mean_loss(loss: str, level: float, e: np.ndarray) -> np.ndarray:
    """The loss itself, by row."""
    if loss == "squared":
        return e * e
    if loss == "huber":
        a = np.abs(e)
        return np.where(a <= level, e * e / 2, level * (a - level / 2))
    above = 0.5 if loss == "absolute" else level
    return np.where(e > 0, (1 - above) * e, -above * e)


def binned(values: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Bins by feature: 0 is missing, k + 1 has k edges below it."""
    out = np.zeros(values.shape, np.uint8)
    for j, e in enumerate(edges):
        x = values[:, j]
        out[:, j] = np.where(np.isnan(x), 0, 1 + np.searchsorted(e, x, side="left"))
    return out


def best_splits(slopes: np.ndarray, counts: np.ndarray, penalty: float, least: float) -> tuple[np.ndarray, ...]:
    """(feature, bin, gain, left slopes, left counts) of each node from its sums by (node, feature, bin).

    Rows of bins up to the split's go left. A node without a gain stays whole, all of it left.
    The first of equal gains in order of feature and bin is taken.
    """
    g, n = np.cumsum(slopes, axis=2), np.cumsum(counts, axis=2)
    all_g, all_n = g[:, :, -1:], n[:, :, -1:]
    part = lambda a, b: a * a / (b + penalty)
    gain = part(g, n) + part(all_g - g, all_n - n) - part(all_g, all_n)
    gain[(n < least) | (all_n - n < least)] = -np.inf
    flat = gain[:, :, :-1].reshape(len(g), -1)
    best = flat.argmax(axis=1)
    feature, cut = np.divmod(best, g.shape[2] - 1)
    node = np.arange(len(g))
    top = flat[node, best]
    none = ~(top > 1e-10)
    feature, cut = np.where(none, 0, feature), np.where(none, _ALL_LEFT, cut)
    at = np.minimum(cut, g.shape[2] - 1)
    return feature, cut, np.where(none, 0.0, top), g[node, feature, at], n[node, feature, at]


@dataclass
class Tree:
    """A complete binary tree: node i has children 2i + 1 and 2i + 2; rows of bins above ``cut`` go right."""

    feature: np.ndarray
    cut: np.ndarray
    gain: np.ndarray
    cover: np.ndarray
    value: np.ndarray


@dataclass
class BoostedTrees:
    """Trees for a loss: squared, absolute, quantile (``level``) or huber (``level`` is where it turns linear).

    With rows whose split is val and ``patience``, growth ends that many trees after the best one
    and the model is cut there. ``workers`` tasks must run at the same time (a barrier).
    """

    features: list[str]
    trees: int = 3000
    depth: int = 6
    rate: float = 0.05
    loss: str = "squared"
    level: float = 0.5
    bins: int = 64
    penalty: float = 1.0
    least: int = 1
    patience: int | None = None
    workers: int | None = None
    round_trees: int = 500
    forest: list[Tree] = field(default_factory=list, repr=False)
    edges: list[np.ndarray] = field(default_factory=list, repr=False)
    start: float = 0.0
    #: Mean loss of train and val rows after each tree.
    train_losses: list[float] = field(default_factory=list, repr=False)
    val_losses: list[float] = field(default_factory=list, repr=False)

    def fit(self, df: DataFrame, y: str = "y", split: str = "split") -> BoostedTrees:
        """Learns from rows whose split is train; those without a target are left out."""
        if not 2 <= self.bins <= 250:
            raise ValueError("bins: 2 to 250")
        number = [F.col(c).cast("double").alias(f"_x{k}") for k, c in enumerate(self.features)]
        rows = df.filter(F.col(split).isin("train", "val")).select(*number, F.col(y).cast("double").alias("_y"), (F.col(split) == "val").alias("_val")).filter(F.col("_y").isNotNull())
        train = rows.filter(~F.col("_val"))
        places = [k / self.bins for k in range(1, self.bins)]
        middle = {"absolute": 0.5, "huber": 0.5, "quantile": self.level}.get(self.loss)
        begin = F.avg("_y") if middle is None else F.percentile_approx("_y", F.lit(middle), 10_000)
        facts = train.agg(begin.alias("start"), *[F.percentile_approx(F.when(~F.isnan(f"_x{k}"), F.col(f"_x{k}")), places, 10_000).alias(f"e{k}") for k in range(len(number))]).head()
        if facts["start"] is None:
            raise ValueError("no training row has a target")
        self.start, self.forest, self.train_losses, self.val_losses = float(facts["start"]), [], [], []
        self.edges = [np.unique(np.array(facts[f"e{k}"] or [], float)) for k in range(len(number))]
        workers = self.workers or min(8, df.sparkSession.sparkContext.defaultParallelism)
        dealt = rows.repartition(workers)
        while len(self.forest) < self.trees and not self._stopped():
            self._grow(dealt, min(self.round_trees, self.trees - len(self.forest)))
        if self.patience is not None:
            self.forest = self.forest[: self.best_iteration]
        return self

    @property
    def best_iteration(self) -> int:
        """Number of trees with the least val loss, all without val rows; the first of equal ones."""
        seen = [v for v in self.val_losses if v == v]
        return int(np.argmin(seen)) + 1 if seen else len(self.forest)

    def _stopped(self) -> bool:
        return self.patience is not None and len(self.val_losses) - self.best_iteration >= self.patience

    def _grow(self, rows: DataFrame, trees: int) -> None:
        own = self

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, target, val = own._held(batches)
            tasks = Together(BarrierTaskContext.get())
            train = ~val
            guess = own._sum(codes)
            e = guess - target
            kept = codes[train]
            val_losses, best, best_at, done = list(own.val_losses), np.inf, 0, 0
            for k, v in enumerate(val_losses):
                if v < best:
                    best, best_at = v, k + 1
            waiting: Tree | None = None

            while True:
                loss = mean_loss(own.loss, own.level, e)
                facts = np.array([loss[train].sum(), train.sum(), loss[val].sum(), val.sum()])
                g = slope(own.loss, own.level, e[train])
                node = np.zeros(len(g), np.int64)
                tree = Tree(*(np.zeros(2**own.depth - 1, t) for t in (np.int32, np.int32, float)), np.zeros(2 ** (own.depth + 1) - 1), np.zeros(2**own.depth))
                hist = None
                for level in range(own.depth):
                    left = node % 2 == 0 if level else np.ones(len(g), bool)
                    part = own._histogram(kept[left], node[left] >> min(level, 1), g[left], max(1, 2**level // 2))
                    total = tasks.sum(np.concatenate([facts, part.ravel()]) if not level else part.ravel())
                    if not level:
                        if waiting is not None:
                            means = [total[0] / max(total[1], 1), total[2] / total[3] if total[3] else np.nan]
                            if not tasks.rank:
                                yield _packed(waiting, means)
                            val_losses.append(means[1])
                            if means[1] < best:
                                best, best_at = means[1], len(val_losses)
                            done += 1
                            if done == trees or own.patience is not None and best_at and len(val_losses) - best_at >= own.patience:
                                tasks.close()
                                return
                        total = total[4:]
                    total = total.reshape(part.shape)
                    if level:
                        both = np.empty((2, 2 * len(total[0]), *total.shape[2:]))
                        both[:, 0::2], both[:, 1::2] = total, hist - total
                        hist = both
                    else:
                        hist = total
                    feature, cut, gain, left_g, left_n = best_splits(hist[0], hist[1], own.penalty, own.least)
                    first = 2**level - 1
                    at = slice(first, 2 * first + 1)
                    tree.feature[at], tree.cut[at], tree.gain[at] = feature, cut, gain
                    tree.cover[at] = hist[1][:, 0].sum(axis=1)
                    right = kept[np.arange(len(node)), feature[node]] > cut[node]
                    node = 2 * node + right
                    if level == own.depth - 1:
                        all_g = hist[0][:, 0].sum(axis=1)
                        slopes, counts = (np.stack([a, b - a], axis=1).ravel() for a, b in ((left_g, all_g), (left_n, tree.cover[at])))
                        tree.cover[2 * first + 1 :] = counts
                        tree.value[:] = np.where(counts > 0, -own.rate * slopes / (counts + own.penalty), 0.0)
                e = e + own._sum(codes, [tree])
                waiting = tree

        schema = "feature array<int>, cut array<int>, gain array<double>, cover array<double>, value array<double>, train double, val double"
        for r in rows.mapInArrow(run, schema, barrier=True).collect():  # a row a tree
            self.forest.append(Tree(np.array(r.feature, np.int32), np.array(r.cut, np.int32), np.array(r.gain), np.array(r.cover), np.array(r.value)))
            self.train_losses.append(r.train)
            self.val_losses.append(r.val)

    def _held(self, batches: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        codes, target, val = [np.zeros((0, len(self.features)), np.uint8)], [np.zeros(0)], [np.zeros(0, bool)]
        for batch in batches:
            x = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in range(len(self.features))])
            codes.append(binned(x, self.edges))
            target.append(batch.column(len(self.features)).to_numpy(zero_copy_only=False))
            val.append(batch.column(len(self.features) + 1).to_numpy(zero_copy_only=False).astype(bool))
        return np.concatenate(codes), np.concatenate(target), np.concatenate(val)

    def _histogram(self, codes: np.ndarray, node: np.ndarray, g: np.ndarray, nodes: int) -> np.ndarray:
        """Sums of slopes and counts by (node, feature, bin)."""
        wide = self.bins + 1
        out = np.empty((2, nodes, codes.shape[1], wide))
        for j in range(codes.shape[1]):
            cell = node * wide + codes[:, j]
            out[0, :, j] = np.bincount(cell, g, nodes * wide).reshape(nodes, wide)
            out[1, :, j] = np.bincount(cell, minlength=nodes * wide).reshape(nodes, wide)
        return out

    def _sum(self, codes: np.ndarray, trees: list[Tree] | None = None) -> np.ndarray:
        """Sum of the trees' values by row; of the whole model also the start."""
        forest = self.forest if trees is None else trees
        out = np.full(len(codes), self.start if trees is None else 0.0)
        row = np.arange(len(codes))
        for t in forest:
            at = np.zeros(len(codes), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (codes[row, t.feature[at]] > t.cut[at])
            out += t.value[at - (2**self.depth - 1)]
        return out

    def _inputs(self) -> list[Column]:
        return [F.col(c).cast("double") for c in self.features]

    def predict(self, df: DataFrame, name: str = "yhat", trees: int | None = None) -> DataFrame:
        """Adds the prediction of the first ``trees`` trees (all); missing features have the lowest bin."""
        own = self._first(trees)

        @F.pandas_udf("double")
        def value(*columns: pd.Series) -> pd.Series:
            return pd.Series(own._sum(binned(np.column_stack([c.to_numpy(float) for c in columns]), own.edges)))

        return df.withColumn(name, value(*self._inputs()))

    def _first(self, trees: int | None) -> BoostedTrees:
        settings = {k: getattr(self, k) for k in ("features", "depth", "edges", "start")}
        return BoostedTrees(**settings, forest=self.forest[:trees])

    def importances(self) -> dict[str, float]:
        """Each feature's share of all gains."""
        total = np.zeros(len(self.features))
        for t in self.forest:
            np.add.at(total, t.feature, t.gain)
        return dict(zip(self.features, (total / max(total.sum(), 1e-300)).tolist()))

    # --- attributions -------------------------------------------------------------------------------------

    @property
    def expected(self) -> float:
        """Mean prediction of the training rows, from the trees' covers."""
        return self.start + sum(float(t.value @ t.cover[2**self.depth - 1 :]) / t.cover[0] for t in self.forest)

    def attribute(self, df: DataFrame, name: str = "shap") -> DataFrame:
        """Adds each feature's exact Shapley value (an array in order of features), path dependent.

        The value of a set of features is the mean of the trees with these known, where an unknown
        one follows both branches by their covers. Values add up to prediction less ``expected``.
        """
        own = self._first(None)

        @F.pandas_udf("array<double>")
        def values(*columns: pd.Series) -> pd.Series:
            codes = binned(np.column_stack([c.to_numpy(float) for c in columns]), own.edges)
            parts = [own._attributions(codes[k : k + 256]) for k in range(0, len(codes), 256)]
            return pd.Series([r for p in parts for r in p])

        return df.withColumn(name, values(*self._inputs()))

    def _attributions(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), len(self.features)))
        nodes, turns = _paths(self.depth)
        for t in self.forest:
            table, slot = _leaf_tables(t, nodes, turns, self.depth, len(self.features))
            right = codes[:, t.feature] > t.cut
            off = np.zeros((len(codes), 2**self.depth), np.int64)
            for d in range(self.depth):
                off |= (right[:, nodes[:, d]] != turns[:, d]).astype(np.int64) << slot[:, d]
            known = 2**self.depth - 1 - off
            out += table[np.arange(2**self.depth), known].sum(axis=1)
        return out


def _packed(t: Tree, means: list[float]) -> pa.RecordBatch:
    columns = [pa.array([x.tolist()], k) for x, k in ((t.feature, pa.list_(pa.int32())), (t.cut, pa.list_(pa.int32())), (t.gain, pa.list_(pa.float64())), (t.cover, pa.list_(pa.float64())), (t.value, pa.list_(pa.float64())))]
    return pa.RecordBatch.from_arrays([*columns, *(pa.array([m], pa.float64()) for m in means)], ["feature", "cut", "gain", "cover", "value", "train", "val"])


def _paths(depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes above each leaf, and whether its path turns right there."""
    leaf = np.arange(2**depth) + 2**depth - 1
    nodes, turns = np.zeros((2**depth, depth), np.int64), np.zeros((2**depth, depth), bool)
    for d in range(depth - 1, -1, -1):
        turns[:, d] = leaf % 2 == 0
        leaf = (leaf - 1) // 2
        nodes[:, d] = leaf
    return nodes, turns


def _leaf_tables(t: Tree, nodes: np.ndarray, turns: np.ndarray, depth: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    """(Shapley values of each leaf by the set of its path's features that lead a row there, slots).

    The features of a path have slots, a repeated one the slot of its first node; the slots left
    over stand for features that change nothing. A slot's share is the covers' product along its nodes.
    """
    leaves = np.arange(len(nodes))
    feature = t.feature[nodes]
    child = 2 * nodes + 1 + turns
    share = np.where(t.cover[nodes] > 0, t.cover[child] / np.maximum(t.cover[nodes], 1e-300), 0.0)
    slot = np.array([[int(np.argmax(row[: d + 1] == row[d])) for d in range(depth)] for row in feature])
    z = np.ones((len(nodes), depth))
    for d in range(depth):
        z[leaves, slot[:, d]] *= share[:, d]
    real = slot == np.arange(depth)
    o = (np.arange(2**depth)[:, None] >> np.arange(depth)) & 1
    out = np.zeros((len(nodes), 2**depth, features))
    weight = np.array([_weight(k, depth) for k in range(depth)])
    for i in range(depth):
        if not real[:, i].any():
            continue
        # coefficients of the product of (share + followed * x) over the other slots: sums over sets by size
        c = np.zeros((len(nodes), 2**depth, depth))
        c[:, :, 0] = 1.0
        for j in range(depth):
            if j != i:
                known = np.where(real[:, j, None], o[None, :, j], 1)
                up = c * z[:, j, None, None]
                up[:, :, 1:] += c[:, :, :-1] * known[:, :, None]
                c = up
        phi = t.value[:, None] * (o[None, :, i] - z[:, i, None]) * (c @ weight)
        at = np.flatnonzero(real[:, i])
        out[at, :, feature[at, i]] += phi[at]
    return out, slot


def _weight(k: int, n: int) -> float:
    from math import factorial

    return factorial(k) * factorial(n - 1 - k) / factorial(n)
