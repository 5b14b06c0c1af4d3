"""Grids, boxes, patches and vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Both bounds included: (lat_min, lat_max, lon_min, lon_max)."""
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def cells_in_boxes(cells: DataFrame, boxes: DataFrame) -> DataFrame:
    """(cell columns, box): containment, resolved once on the distinct cells of a grid.

    Boxes are a dictionary of named regions, a few dozen rows of fixed size.
    """
    inside = (F.col("lat") >= F.col("lat_min")) & (F.col("lat") <= F.col("lat_max")) & (F.col("lon") >= F.col("lon_min")) & (F.col("lon") <= F.col("lon_max"))
    return cells.join(F.broadcast(boxes), inside).select(*cells.columns, "box")


def nearest_index(points: DataFrame, axis: DataFrame, coordinate: str, name: str) -> DataFrame:
    """Adds the index of the nearest value of an axis (index, value) to each point; the first of equal ones.

    The axis is a grid's, some hundred values: it travels as one row with an array.
    """
    held = axis.agg(F.collect_list(F.struct("index", "value")).alias("_axis"))  # one row
    nearest = F.array_min(F.transform("_axis", lambda a: F.struct(F.abs(F.col(coordinate) - a["value"]).alias("d"), a["index"].alias("i"))))["i"]
    return points.crossJoin(F.broadcast(held)).withColumn(name, nearest).drop("_axis")


def patch_window(df: DataFrame, row: int, column: int, size: int, rows: int, columns: int) -> DataFrame:
    """The (2 size + 1)-square of patches around one, cut at the edges."""
    return df.filter(F.col("row").between(max(row - size, 0), min(row + size, rows - 1)) & F.col("col").between(max(column - size, 0), min(column + size, columns - 1)))


def snap_box(box: tuple[float, float, float, float], origin: tuple[float, float], steps: tuple[float, float], multiple: int = 1) -> tuple[int, int, int, int]:
    """(first row, last row, first column, last column) of the grid cells nearest to a box's corners.

    Rows and columns must be divisible by ``multiple`` (a model's patch size).
    """
    at = lambda x, k: int(np.floor((x - origin[k]) / steps[k] + 0.5))
    r0, r1, c0, c1 = at(box[0], 0), at(box[1], 0), at(box[2], 1), at(box[3], 1)
    if (r1 - r0 + 1) % multiple or (c1 - c0 + 1) % multiple:
        raise ValueError(f"{r1 - r0 + 1} rows and {c1 - c0 + 1} columns can't be dealt into patches of {multiple}")
    return r0, r1, c0, c1


def regrid(lat: Column, lon: Column, lat0: float, lon0: float, step: float | tuple[float, float], rows: int, columns: int) -> tuple[Column, Column]:
    """Patch indices of coordinates, by floor, kept inside the grid; one step or one for each axis."""
    down, across = step if isinstance(step, tuple) else (step, step)
    clip = lambda x, n: F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(n - 1)).cast("int")
    return clip((lat - lat0) / down, rows), clip((lon - lon0) / across, columns)


def retile(block: Column, inside: Column, blocks_wide: int, wide: int, high: int) -> tuple[Column, Column]:
    """(row, column) on the map of a place inside a block."""
    row = F.floor(block / blocks_wide) * high + F.floor(inside / wide)
    return row.cast("int"), ((block % blocks_wide) * wide + inside % wide).cast("int")


def bilinear(points: DataFrame, grid: DataFrame, value: str) -> DataFrame:
    """Value at fractional (row, col) of each point (id) from the four patches around it."""
    corners = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])
    r0, c0 = F.floor("r"), F.floor("c")
    spread = points.withColumn("k", F.explode(corners)).select(
        "id",
        (r0 + F.col("k.a")).cast("int").alias("row"),
        (c0 + F.col("k.b")).cast("int").alias("col"),
        (F.when(F.col("k.a") == 1, F.col("r") - r0).otherwise(1 - F.col("r") + r0) * F.when(F.col("k.b") == 1, F.col("c") - c0).otherwise(1 - F.col("c") + c0)).alias("weight"),
    )
    return spread.join(grid, ["row", "col"]).groupBy("id").agg(F.sum(F.col("weight") * F.col(value)).alias(value))


def outlines(rings: DataFrame) -> DataFrame:
    """(zone, a, b): the sides of a zone's rings (zone, part, ring, points) that no other part shares, as pairs of points.

    Parts that touch along a whole side, as those of a map do, dissolve into one shape: a side
    that stands in two rings is inside it.
    """
    n = F.size("points")
    sides = F.zip_with(F.slice("points", F.lit(1), n - 1), F.slice("points", F.lit(2), n - 1), lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))
    each = rings.select("zone", F.explode(sides).alias("_s")).select("zone", "_s.*").filter("a <> b")
    return each.groupBy("zone", "a", "b").agg(F.count(F.lit(1)).alias("_n")).filter("_n % 2 = 1").select("zone", "a", "b")


def union_areas(rings: DataFrame) -> DataFrame:
    """(zone, area) of the union of a zone's parts, which may overlap; holes are rings after the first.

    A sweep: between neighbouring x of vertices and crossings no sides cross, so what the union
    covers there is a width times the length that its parts cover half-way. A zone's rings, a
    map's, are in one task.
    """
    import pandas as pd

    def swept(parts: pd.DataFrame) -> pd.DataFrame:
        sides, owner = [], []
        for k, ring in enumerate(parts["points"]):
            p = np.array([list(q) for q in ring], float)
            if len(p) > 1:
                sides.append(np.column_stack([p[:-1], p[1:]]))
                owner += [parts["part"].iloc[k]] * (len(p) - 1)
        zone = parts["zone"].iloc[0]
        if not sides:
            return pd.DataFrame({"zone": [zone], "area": [0.0]})
        s, owner = np.concatenate(sides), np.array(owner)
        xs = [s[:, 0], s[:, 2]]
        s = np.where((s[:, 0] > s[:, 2])[:, None], s[:, [2, 3, 0, 1]], s)
        up = s[:, 0] < s[:, 2]
        s, owner = s[up], owner[up]
        slope = (s[:, 3] - s[:, 1]) / (s[:, 2] - s[:, 0])
        level = s[:, 1] - slope * s[:, 0]
        for i in range(len(s)):  # where later sides cross this one
            with np.errstate(divide="ignore", invalid="ignore"):
                x = (level[i + 1 :] - level[i]) / (slope[i] - slope[i + 1 :])
            xs.append(x[(x > np.maximum(s[i, 0], s[i + 1 :, 0])) & (x < np.minimum(s[i, 2], s[i + 1 :, 2]))])
        cuts, area = np.unique(np.concatenate(xs)), 0.0
        for lo, hi in zip(cuts, cuts[1:]):
            here = np.flatnonzero((s[:, 0] <= lo) & (s[:, 2] >= hi))
            y = slope[here] * (lo + hi) / 2 + level[here]
            spans = []
            for part in np.unique(owner[here]):
                own = np.sort(y[owner[here] == part])
                spans += zip(own[::2], own[1::2])
            top = -np.inf
            for a, b in sorted(spans):
                area += (hi - lo) * max(0.0, b - max(a, top))
                top = max(top, b)
        return pd.DataFrame({"zone": [zone], "area": [area]})

    return rings.groupBy("zone").applyInPandas(swept, f"zone {dict(rings.dtypes)['zone']}, area double")


def points_in_polygons(points: DataFrame, rings: DataFrame, x: str, y: str, step: float) -> DataFrame:
    """(columns of points, zone): the zones with a part around each point, once a zone.

    Polygons are covered by the cells of a grid of ``step``; a point meets only the parts whose
    cover has its cell, by equality, and is then tested against their rings.
    """
    from ..sources.tables import inside_ring

    cell = lambda v: F.floor(v / F.lit(step)).cast("long")
    over = lambda k, f: f(F.transform(F.element_at("_rings", 1), lambda p: p[k]))
    parts = rings.groupBy("zone", "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("ring", "points"))), lambda r: r["points"]).alias("_rings"))  # a part's rings
    span = lambda k: F.explode(F.sequence(cell(over(k, F.array_min)), cell(over(k, F.array_max))))
    cover = parts.withColumn("_i", span(0)).withColumn("_j", span(1))
    placed = points.withColumns({"_i": cell(F.col(x)), "_j": cell(F.col(y)), "_at": F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))})
    crossed = F.aggregate("_rings", F.lit(0), lambda n, r: n + inside_ring(F.col("_at.x"), F.col("_at.y"), r).cast("int"))
    met = placed.join(cover, ["_i", "_j"]).filter(crossed % 2 == 1)
    return met.select(*points.columns, "zone").distinct()


def gram_pca(rows: DataFrame, key: str, vector: str, k: int, fields: int = 1, train: str | None = None, block: int = 512, most: int = 4096, rounds: int = 60) -> DataFrame:
    """(key, pc0, pc1, ...): scores on the components of rows with more cells than there are rows.

    A vector is ``fields`` fields of equally many cells. Each cell is centred, each field divided
    by one deviation pooled over its cells, both from the rows where ``train`` holds (all). For
    ``most`` training rows at most, blocks of them are multiplied pairwise in tasks and the
    matrix of all products is split into components; with more, the first components come from
    orthogonal iteration, a pass over the rows each, and no matrix of rows is made. Components
    are signed so that their largest training score is positive. Keys must be distinct.
    """
    import pandas as pd

    from .panel import numbered as in_order

    spark = rows.sparkSession
    kind = dict(rows.dtypes)[key]
    held = rows.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"), (F.expr(train) if train else F.lit(True)).alias("t"))
    n, mean, square = _cell_sums(held.filter("t"), "v")
    if not n:
        raise ValueError("no training row")
    variance = np.maximum(square - mean**2, 0).reshape(fields, -1).mean(axis=1)
    scale = np.repeat(np.where(variance > 1e-24, np.sqrt(variance), 1.0), len(mean) // fields)
    sent = spark.sparkContext.broadcast((mean, scale))  # a row's size

    def matrix(v: pd.Series) -> np.ndarray:
        m, s = sent.value
        return (np.stack(v.to_numpy()) - m) / s if len(v) else np.zeros((0, len(m)))

    def passes(q: np.ndarray, only: str) -> np.ndarray:
        """Sum over rows of row' (row q): one pass."""

        def run(batches):
            total = np.zeros(q.shape)
            for batch in batches:
                for lo in range(0, len(batch), block):
                    x = matrix(batch["v"].iloc[lo : lo + block])
                    total += x.T @ (x @ q)
            yield pd.DataFrame({"i": np.arange(q.size, dtype=np.int64), "x": total.ravel()})

        sums = held.filter(only).select("v").mapInPandas(run, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()  # cells times components
        out = np.zeros(q.size)
        out[sums["i"]] = sums["x"]
        return out.reshape(q.shape)

    if n <= most:
        blocks = -(-n // block)
        numbered = in_order(held.filter("t").select("k", "v"), "k", "k", "n").withColumn("b", F.floor(F.col("n") / block))
        pairs = F.explode(F.array(*[F.struct(F.least(F.col("b"), F.lit(o)).alias("i"), F.greatest(F.col("b"), F.lit(o)).alias("j")) for o in range(blocks)])).alias("_pair")

        def products(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("n")
            x = matrix(part["v"])
            a, b = part["b"] == part["i"].iloc[0], part["b"] == part["j"].iloc[0]
            return pd.DataFrame({"i": [part["i"].iloc[0]], "j": [part["j"].iloc[0]], "g": [(x[a.to_numpy()] @ x[b.to_numpy()].T).ravel()]})

        found = numbered.select("n", "b", "v", pairs).select("n", "b", "v", "_pair.*").distinct().groupBy("i", "j").applyInPandas(products, "i long, j long, g array<double>").collect()  # most ** 2 numbers
        gram = np.zeros((n, n))
        for r in found:
            a, b = (slice(x * block, min(n, (x + 1) * block)) for x in (r.i, r.j))
            gram[a, b] = np.array(r.g).reshape(a.stop - a.start, -1)
            gram[b, a] = gram[a, b].T
        values, vectors = np.linalg.eigh(gram)
        u = vectors[:, ::-1][:, :k]
        # components in cells: one more pass, rows times their weights
        numbers = numbered.select("n", "v")

        def lifted(batches):
            total = np.zeros((len(mean), u.shape[1]))
            for batch in batches:
                for lo in range(0, len(batch), block):
                    total += matrix(batch["v"].iloc[lo : lo + block]).T @ u[batch["n"].iloc[lo : lo + block].to_numpy()]
            yield pd.DataFrame({"i": np.arange(total.size, dtype=np.int64), "x": total.ravel()})

        sums = numbers.mapInPandas(lifted, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
        w = np.zeros(len(mean) * u.shape[1])
        w[sums["i"]] = sums["x"]
        w = w.reshape(len(mean), -1)
    else:
        w = np.linalg.qr(np.random.default_rng(7).normal(size=(len(mean), min(len(mean), k + 8))))[0]
        for _ in range(rounds):
            now, _ = np.linalg.qr(passes(w, "t"))
            near = np.linalg.norm(w[:, :k] - now @ (now.T @ w[:, :k]))
            w = now
            if near < 1e-9:
                break
        # turned to the components themselves
        small = w.T @ passes(w, "t")
        values, turn = np.linalg.eigh((small + small.T) / 2)
        w = w @ turn[:, ::-1]
    w = w[:, :k]
    w = w / np.maximum(np.linalg.norm(w, axis=0), 1e-12)

    def scores(batches):
        for batch in batches:
            parts = [matrix(batch["v"].iloc[lo : lo + block]) @ w for lo in range(0, len(batch), block)]
            s = np.concatenate(parts) if parts else np.zeros((0, w.shape[1]))
            yield pd.DataFrame({"k": batch["k"], "t": batch["t"], "s": list(s)})

    found = held.mapInPandas(scores, f"k {kind}, t boolean, s array<double>")
    # the sign: of the largest training score of each component
    ends = found.filter("t").agg(*[F.max_by(F.col("s")[j], F.abs(F.col("s")[j])).alias(f"e{j}") for j in range(w.shape[1])]).head()
    turn = [-1.0 if (e or 0) < 0 else 1.0 for e in ends]
    return found.select(F.col("k").alias(key), *[(F.col("s")[j] * turn[j]).alias(f"pc{j}") for j in range(w.shape[1])])


def _cell_sums(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, mean, mean square) of each cell of vectors, from sums of each task."""
    import pandas as pd

    def run(batches):
        n, s, q = 0, None, None
        for batch in batches:
            if len(batch):
                x = np.stack(batch[vector].to_numpy())
                n, s, q = n + len(x), x.sum(0) if s is None else s + x.sum(0), (x * x).sum(0) if q is None else q + (x * x).sum(0)
        if n:
            yield pd.DataFrame({"i": np.arange(2 * s.size + 1), "x": np.concatenate([[n], s, q])})

    sums = df.select(vector).mapInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")["x"].to_numpy()  # two rows' size
    if not len(sums):
        return 0, np.zeros(0), np.zeros(0)
    d = (len(sums) - 1) // 2
    return int(sums[0]), sums[1 : 1 + d] / sums[0], sums[1 + d :] / sums[0]


def vector_mean(df: DataFrame, by: list[str], vector: str) -> DataFrame:
    """Element-wise mean of vectors, as (by, vector); pre-aggregated element by element."""
    long = df.select(*by, F.posexplode(vector).alias("_i", "_x"))
    means = long.groupBy(*by, "_i").agg(F.avg("_x").alias("_x"))
    return means.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", "_x"))), lambda s: s["_x"]).alias(vector))


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, mean, covariance with ddof 0) of all vectors, from partial sums of each task."""
    import pandas as pd

    def run(batches):
        n, s, q = 0, None, None
        for batch in batches:
            x = np.stack(batch[vector].to_numpy()).astype(float) if len(batch) else None
            if x is not None:
                n, s, q = n + len(x), x.sum(0) if s is None else s + x.sum(0), x.T @ x if q is None else q + x.T @ x
        if n:
            yield pd.DataFrame({"i": np.arange(1 + s.size + q.size), "x": np.concatenate([[n], s, q.ravel()])})

    sums = df.select(vector).mapInPandas(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas().sort_values("i")["x"].to_numpy()
    d = int((np.sqrt(1 + 4 * (len(sums) - 1)) - 1) / 2)
    n, s, q = sums[0], sums[1 : 1 + d], sums[1 + d :].reshape(d, d)
    return int(n), s / n, q / n - np.outer(s / n, s / n)


class Pca:
    """Components of standardised vectors, fitted on training rows only; deviations of zero count as one."""

    def __init__(self, train: DataFrame, vector: str, k: int):
        _, self.mean, cov = moments(train, vector)
        sd = np.sqrt(np.diag(cov))
        self.sd = np.where(sd > 1e-12, sd, 1.0)
        values, vectors = np.linalg.eigh(cov / np.outer(self.sd, self.sd))
        order = np.argsort(-values)[:k]
        self.share = values[order] / max(values.sum(), 1e-12)
        v = vectors[:, order]
        self.components = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(v.shape[1])])

    def transform(self, df: DataFrame, vector: str, name: str = "pc") -> DataFrame:
        """Scores as an array column, on column expressions only."""
        z = F.transform(F.col(vector), lambda x, i: (x - F.array(*map(F.lit, self.mean.tolist()))[i]) / F.array(*map(F.lit, self.sd.tolist()))[i])
        df = df.withColumn("_z", z)
        one = lambda w: F.aggregate(F.zip_with("_z", F.array(*map(F.lit, w.tolist())), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        return df.withColumn(name, F.array(*[one(self.components[:, j]) for j in range(self.components.shape[1])])).drop("_z")
