"""Models: each is fitted on rows whose split is train and adds a prediction to all rows."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .heads import fitted_in_blocks


def training_mean(df: DataFrame, by: list[str], y: str = "y", name: str = "yhat") -> DataFrame:
    """Training mean of each group (a climatology, if the groups are hours or months)."""
    means = df.filter("split = 'train'").groupBy(*by).agg(F.avg(y).alias(name))
    return df.join(means, by, "left")


def persistence(df: DataFrame, by: list[str], seconds: int, y: str = "y", name: str = "yhat") -> DataFrame:
    """The value known when the forecast was issued, ``seconds`` before."""
    from .temporal import exact_lag

    return exact_lag(df, by, y, {name: seconds})


def bias_corrected(df: DataFrame, by: list[str], forecast: str, y: str = "y", name: str = "yhat") -> DataFrame:
    """A forecast less its mean training error by group; groups without training rows stay."""
    bias = df.filter("split = 'train'").groupBy(*by).agg(F.avg(F.col(forecast) - F.col(y)).alias("_bias"))
    return df.join(bias, by, "left").withColumn(name, F.col(forecast) - F.coalesce("_bias", F.lit(0.0))).drop("_bias")


class Linear:
    """Least squares with an optional ridge penalty on standardised features and a free intercept.

    The normal equations come from one aggregate over the training rows, so the data never
    leave the executors; only (features + 2) squared sums do.
    """

    def __init__(self, features: list[str], penalty: float = 0.0):
        self.features, self.penalty = features, penalty

    def fit(self, train: DataFrame, y: str = "y") -> Linear:
        columns = [F.lit(1.0), *[F.col(c).cast("double") for c in self.features], F.col(y).cast("double")]
        rows = train.dropna(subset=[*self.features, y])
        pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
        sums = rows.agg(*[F.coalesce(F.sum(columns[i] * columns[j]), F.lit(0.0)).alias(f"s{i}_{j}") for i, j in pairs]).head()
        m = np.zeros((len(columns),) * 2)
        for (i, j), v in zip(pairs, sums):
            m[i, j] = m[j, i] = v
        n, k = max(m[0, 0], 1.0), len(self.features)
        mean = m[0, 1 : k + 1] / n
        cov = m[1 : k + 1, 1 : k + 1] - n * np.outer(mean, mean)
        cross = m[1 : k + 1, -1] - mean * m[0, -1]
        sd = np.sqrt(np.maximum(np.diag(cov) / n, 0))
        sd[sd < 1e-12] = 1.0
        a = cov / np.outer(sd, sd) + self.penalty * np.eye(k)
        self.coefficients = np.linalg.lstsq(a, cross / sd, rcond=None)[0] / sd
        self.intercept = m[0, -1] / n - mean @ self.coefficients
        return self

    def predict(self, df: DataFrame, name: str = "yhat") -> DataFrame:
        terms = [F.col(c) * float(w) for c, w in zip(self.features, self.coefficients)]
        return df.withColumn(name, reduce(lambda a, b: a + b, terms, F.lit(float(self.intercept))))


def ridge_by_validation(df: DataFrame, features: list[str], penalties: list[float], y: str = "y", name: str = "yhat") -> DataFrame:
    """The penalty of least squared error on rows whose split is val, fitted on train rows; the least of equal ones.

    Sums of products of both splits come from one aggregate; fits and errors follow from them.
    """
    sums = _fold_sums(df.filter(F.col("split").isin("train", "val")), features, "split", y)
    m, val = sums["train"], sums.get("val", np.zeros_like(sums["train"]))
    fits = [(p, _penalised(m, p / max(m[0, 0], 1.0), 0.0)) for p in sorted(penalties)]
    error = lambda w: float(np.append(-w, 1.0) @ val @ np.append(-w, 1.0))
    best, w = min(fits, key=lambda f: (error(f[1]), f[0]))
    model = Linear(features, best)
    model.intercept, model.coefficients = float(w[0]), w[1:]
    return model.predict(df, name)


def _fold_sums(df: DataFrame, features: list[str], fold: str, y: str) -> dict[int, np.ndarray]:
    """Each fold's matrix of summed products of (1, features, y), from one aggregate."""
    columns = [F.lit(1.0), *[F.col(c).cast("double") for c in features], F.col(y).cast("double")]
    n = len(columns)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    sums = df.dropna(subset=[*features, y]).groupBy(fold).agg(*[F.sum(columns[i] * columns[j]).alias(f"s{i}_{j}") for i, j in pairs]).collect()  # a row a fold
    out = {}
    for r in sums:
        m = np.zeros((n, n))
        for (i, j), v in zip(pairs, r[1:]):
            m[i, j] = m[j, i] = v
        out[r[0]] = m
    return out


def _penalised(m: np.ndarray, alpha: float, l1: float, rounds: int = 500) -> np.ndarray:
    """(intercept, coefficients) of least squares with penalty alpha * n * (l1 |b| + (1 - l1) b^2 / 2) on standardised
    features, by coordinate descent on the sums."""
    n, k = m[0, 0], len(m) - 2
    mean = m[0, 1:-1] / n
    sd = np.sqrt(np.maximum(np.diag(m)[1:-1] / n - mean**2, 0))
    sd[sd < 1e-12] = 1.0
    a = (m[1:-1, 1:-1] / n - np.outer(mean, mean)) / np.outer(sd, sd)
    c = (m[1:-1, -1] / n - mean * m[0, -1] / n) / sd
    b = np.zeros(k)
    for _ in range(rounds):
        before = b.copy()
        for j in range(k):
            g = c[j] - a[j] @ b + a[j, j] * b[j]
            b[j] = np.sign(g) * max(abs(g) - alpha * l1, 0.0) / (a[j, j] + alpha * (1 - l1)) if a[j, j] > 0 else 0.0
        if np.abs(b - before).max(initial=0) < 1e-12:
            break
    b = b / sd
    return np.concatenate([[m[0, -1] / n - mean @ b], b])


def cross_validated(df: DataFrame, features: list[str], alphas: list[float], l1: float = 0.0, fold: str = "fold", y: str = "y") -> tuple[Linear, float]:
    """Ridge (l1 = 0), lasso (1) or elastic net with the penalty of least error over the folds: (model, penalty).

    One aggregate gives each fold's sums; fits and errors of all folds and penalties follow
    from these, so the rows are read once however long the list of penalties is.
    """
    folds = _fold_sums(df, features, fold, y)
    total = sum(folds.values())

    def error(alpha: float) -> float:
        out = 0.0
        for m in folds.values():
            w = np.append(-_penalised(total - m, alpha, l1), 1.0)
            out += w @ m @ w
        return out

    best = min(alphas, key=lambda a: (error(a), a))
    model, w = Linear(features, best), _penalised(total, best, l1)
    model.intercept, model.coefficients = float(w[0]), w[1:]
    return model, best


class Network:
    """A regressor of one hidden layer of tanh units, or a linear one (hidden = 0), for a chosen loss.

    ``loss``: squared, absolute, huber or quantile (then ``level``). A fit deals its rows to
    ``workers`` partitions of cached blocks; a step is a job, of which only sums of gradients
    travel, and a task holds one block at a time. Adam steps on all training rows, whose
    features and target are standardised by one aggregate.
    """

    def __init__(self, features: list[str], hidden: int = 8, loss: str = "squared", level: float = 0.5, steps: int = 80, rate: float = 0.05, seed: int = 7, workers: int | None = None):
        self.workers = workers
        self.features, self.hidden, self.loss, self.level, self.steps, self.rate, self.seed = features, hidden, loss, level, steps, rate, seed

    def _shapes(self) -> list[tuple[int, ...]]:
        k, h = len(self.features), self.hidden
        return [(k, h), (h,), (h,), ()] if h else [(k,), ()]

    def _split(self, w: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for shape in self._shapes():
            n = int(np.prod(shape))
            out.append(w[at : at + n].reshape(shape))
            at += n
        return out

    def _slope(self, e: np.ndarray) -> np.ndarray:
        """Derivative of the loss by the prediction; e: prediction less target."""
        if self.loss == "squared":
            return e
        if self.loss == "huber":
            return np.clip(e, -1.0, 1.0)
        above = self.level if self.loss == "quantile" else 0.5
        return np.where(e > 0, 1 - above, -above)

    def _gradient(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
        parts = self._split(w)
        if not self.hidden:
            g = self._slope(x @ parts[0] + parts[1] - y)
            return np.append(x.T @ g, g.sum())
        h = np.tanh(x @ parts[0] + parts[1])
        g = self._slope(h @ parts[2] + parts[3] - y)
        back = np.outer(g, parts[2]) * (1 - h * h)
        return np.concatenate([(x.T @ back).ravel(), back.sum(0), h.T @ g, [g.sum()]])

    def fit(self, train: DataFrame, y: str = "y") -> Network:
        columns = [*self.features, y]
        rows = train.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
        stats = rows.agg(F.count(F.lit(1)), *[F.avg(c) for c in columns], *[F.stddev_pop(c) for c in columns]).head()
        n, k = stats[0], len(columns)
        self.mean = np.array([v or 0.0 for v in stats[1 : 1 + k]])
        self.sd = np.array([v or 1.0 for v in stats[1 + k :]])
        rng = np.random.default_rng(self.seed)
        w = np.concatenate([rng.normal(0, 1 / np.sqrt(s[0]), s).ravel() if len(s) == 2 else rng.normal(0, 0.3, s).ravel() if s else np.zeros(1) for s in self._shapes()])
        own = self

        def held(batches) -> np.ndarray:  # noqa: ANN001
            parts = [np.column_stack([c.to_numpy(zero_copy_only=False) for c in b.columns]) for b in batches if len(b)]
            return (np.concatenate(parts) - own.mean) / own.sd if parts else np.zeros((0, k))

        # a panel of few rows has one partition a core
        workers = self.workers or train.sparkSession.sparkContext.defaultParallelism
        self.weights = fitted_in_blocks(rows, held, lambda z, w: (own._gradient(z[:, :-1], z[:, -1], w), len(z)), w, self.steps, self.rate, workers) if n else w
        return self

    def predict(self, df: DataFrame, name: str = "yhat") -> DataFrame:
        """On column expressions only; null where a feature is."""
        z = [(F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(self.features, self.mean, self.sd)]
        linear = lambda ws, b: reduce(lambda a, x: a + x, [x * float(w) for x, w in zip(z, ws)], F.lit(float(b)))
        parts = self._split(self.weights)
        if self.hidden:
            units = [F.tanh(linear(parts[0][:, j], parts[1][j])) * float(parts[2][j]) for j in range(self.hidden)]
            out = reduce(lambda a, x: a + x, units, F.lit(float(parts[3])))
        else:
            out = linear(parts[0], parts[1])
        return df.withColumn(name, out * float(self.sd[-1]) + float(self.mean[-1]))


def out_of_fold(df: DataFrame, features: list[str], folds: int = 5, penalty: float = 1.0, y: str = "y", name: str = "oof") -> DataFrame:
    """Each fold predicted by a fit on the others."""
    parts = [Linear(features, penalty).fit(df.filter(F.col("fold") != k), y).predict(df.filter(F.col("fold") == k), name) for k in range(folds)]
    return reduce(DataFrame.unionByName, parts)


def residual_head(df: DataFrame, base: list[str], extra: list[str], y: str = "y", name: str = "yhat", folds: int = 5) -> DataFrame:
    """A base model plus a second one fitted to the base's out-of-fold residuals on other features."""
    held = out_of_fold(df.filter("split = 'train'"), base, folds, y=y).withColumn("_res", F.col(y) - F.col("oof"))
    correction = Linear(extra, 1.0).fit(held, "_res")
    first = Linear(base, 1.0).fit(df.filter("split = 'train'"), y).predict(df, "_base")
    return correction.predict(first, "_fix").withColumn(name, F.col("_base") + F.col("_fix")).drop("_base", "_fix")


def stacked(df: DataFrame, base: list[str], extra: list[str], y: str = "y", name: str = "yhat", folds: int = 5) -> DataFrame:
    """The base model's out-of-fold prediction becomes a feature of the second."""
    train = out_of_fold(df.filter("split = 'train'"), base, folds, y=y, name="_base")
    rest = Linear(base, 1.0).fit(df.filter("split = 'train'"), y).predict(df.filter("split <> 'train'"), "_base")
    both = train.unionByName(rest)
    return Linear(["_base", *extra], 1.0).fit(train, y).predict(both, name).drop("_base")


def feature_sets(blocks: dict[str, list[str]], wanted: list[list[str]], target: str) -> dict[str, list[str]]:
    """Named combinations of feature blocks; a block that holds the target is refused."""
    out = {}
    for names in wanted:
        columns = [c for n in names for c in blocks[n]]
        if target in columns:
            raise ValueError(f"{target} is the target and can't be a feature")
        out[" + ".join(names)] = columns
    return out


def fit_trees(train: DataFrame, numbers: list[str], categories: list[str], y: str = "y", trees: int = 10, depth: int = 4, loss: str = "squared"):
    """Boosted trees with native categories; ``loss`` squared or absolute. Returns the fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer, VectorAssembler, VectorIndexer
    from pyspark.ml.regression import GBTRegressor

    stages = [StringIndexer(inputCol=c, outputCol=f"_{c}", handleInvalid="keep") for c in categories]
    stages.append(VectorAssembler(inputCols=[*numbers, *(f"_{c}" for c in categories)], outputCol="_v", handleInvalid="skip"))
    stages.append(VectorIndexer(inputCol="_v", outputCol="_x", maxCategories=32, handleInvalid="keep"))
    stages.append(GBTRegressor(featuresCol="_x", labelCol=y, predictionCol="yhat", maxIter=trees, maxDepth=depth, maxBins=64, lossType=loss, seed=7))
    return Pipeline(stages=stages).fit(train)


def huber(train: DataFrame, features: list[str], y: str = "y", epsilon: float = 1.35):
    """Linear regression with Huber's loss."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_v", handleInvalid="skip"), LinearRegression(featuresCol="_v", labelCol=y, predictionCol="yhat", loss="huber", epsilon=epsilon, maxIter=50)]).fit(train)
