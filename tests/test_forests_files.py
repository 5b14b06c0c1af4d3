"""Boosted trees against plain numpy, attributions against all subsets, and files read by ranges."""

import io
import itertools
import json
import os
import struct
from datetime import datetime
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quaywise.operators.boosting import BoostedTrees, binned
from quaywise.sources import bundles, grids, records, stores

FEATURES = ["a", "b", "c", "d"]


def _data(n=900, seed=0):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 6, n), rng.normal(size=n), rng.random(n)]).astype(float)
    y = x[:, 0] * 2 + np.where(x[:, 1] > 2, x[:, 2], 0) + rng.normal(0, 0.1, n)
    x[rng.random(n) < 0.1, 2] = np.nan
    frame = pd.DataFrame(x, columns=FEATURES)
    return frame.assign(y=y, split=np.where(np.arange(n) % 5 == 0, "val", np.where(np.arange(n) % 7 == 0, "test", "train")))


@pytest.fixture(scope="module")
def data(spark):
    frame = _data()
    rows = [[None if v != v else v for v in r[:4]] + list(r[4:]) for r in frame.itertuples(index=False)]
    return frame, spark.createDataFrame(rows, "a double, b double, c double, d double, y double, split string").repartition(3)


def _plain(x, y, edges, trees, depth, rate, penalty=1.0):
    """The same trees, grown node by node over all rows: predictions after each tree."""
    codes, guess, out = binned(x, edges), np.full(len(y), y.mean()), []
    for _ in range(trees):
        g, step = guess - y, np.zeros(len(y))

        def grow(rows, level):
            total = g[rows].sum() ** 2 / (len(rows) + penalty)  # noqa: B023
            best = (1e-10, None)
            for f in range(codes.shape[1]) if level < depth else ():
                for cut in range(len(edges[f]) + 1):
                    left = codes[rows, f] <= cut
                    if left.any() and not left.all():
                        gain = sum(g[rows[m]].sum() ** 2 / (m.sum() + penalty) for m in (left, ~left)) - total  # noqa: B023
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, cut))
            if best[1] is None:
                step[rows] = -rate * g[rows].sum() / (len(rows) + penalty)  # noqa: B023
                return
            left = codes[rows, best[1][0]] <= best[1][1]
            grow(rows[left], level + 1)
            grow(rows[~left], level + 1)

        grow(np.arange(len(y)), 0)
        guess = guess + step
        out.append(guess)
    return out


def test_trees_equal_plain_ones(data):
    frame, df = data
    model = BoostedTrees(FEATURES, trees=6, depth=3, rate=0.3, bins=16, workers=3, round_trees=4).fit(df)
    train = frame[frame.split == "train"]
    want = _plain(train[FEATURES].to_numpy(), train.y.to_numpy(), model.edges, 6, 3, 0.3)
    assert np.allclose(model.train_losses, [np.mean((w - train.y.to_numpy()) ** 2) for w in want])
    got = model.predict(df.filter("split = 'train'")).toPandas()
    assert np.allclose(np.sort(got.yhat), np.sort(want[-1]))
    two = model.predict(df.filter("split = 'train'"), trees=2).toPandas()
    assert np.allclose(np.sort(two.yhat), np.sort(want[1]))
    assert abs(model.expected - got.yhat.mean()) < 1e-9
    assert abs(sum(model.importances().values()) - 1) < 1e-9 and max(model.importances(), key=model.importances().get) == "a"


def test_growth_stops_after_the_best_iteration(data):
    frame, df = data
    noisy = df.withColumn("y", F.col("y") + F.when(F.col("split") == "train", 8 * F.sin(F.col("d") * 1e5)).otherwise(0.0))
    model = BoostedTrees(FEATURES, trees=300, depth=5, rate=0.5, patience=7, workers=2, round_trees=11).fit(noisy)
    assert len(model.forest) == model.best_iteration == int(np.argmin(model.val_losses)) + 1
    assert len(model.val_losses) == model.best_iteration + 7 < 300
    got = model.predict(noisy.filter("split = 'val'")).agg(F.avg((F.col("yhat") - F.col("y")) ** 2)).head()[0]
    assert abs(got - min(model.val_losses)) < 1e-9


def test_losses_pull_to_their_own_centre(data):
    _, df = data
    skewed = df.withColumn("y", F.when(F.col("b") > 3, F.lit(100.0)).otherwise(F.col("b")))
    fit = lambda loss, level: BoostedTrees(["a"], trees=200, depth=1, rate=0.5, loss=loss, level=level, workers=2).fit(skewed).predict(skewed).agg(F.avg("yhat")).head()[0]
    assert fit("quantile", 0.9) > fit("quantile", 0.5) and fit("absolute", 0.5) < fit("squared", 0.5) and fit("huber", 1.0) < fit("squared", 0.5)


def test_attributions_equal_all_subsets(data):
    frame, df = data
    model = BoostedTrees(FEATURES, trees=4, depth=3, rate=0.5, bins=8, workers=2).fit(df)
    rows = model.attribute(model.predict(df)).limit(12).collect()

    def value(codes, known):
        def at(tree, node):
            if node >= 2**model.depth - 1:
                return tree.value[node - 2**model.depth + 1]
            f = tree.feature[node]
            left, right = 2 * node + 1, 2 * node + 2
            if f in known:
                return at(tree, right if codes[f] > tree.cut[node] else left)
            if not tree.cover[node]:
                return 0.0
            return (tree.cover[left] * at(tree, left) + tree.cover[right] * at(tree, right)) / tree.cover[node]

        return sum(at(t, 0) for t in model.forest)

    for r in rows:
        codes = binned(np.array([[np.nan if r[f] is None else r[f] for f in FEATURES]]), model.edges)[0]
        for i in range(4):
            others = [j for j in range(4) if j != i]
            want = sum(factorial(k) * factorial(3 - k) / 24 * (value(codes, {*s, i}) - value(codes, set(s))) for k in range(4) for s in itertools.combinations(others, k))
            assert abs(r.shap[i] - want) < 1e-9
        assert abs(sum(r.shap) - (r.yhat - model.expected)) < 1e-9


def test_no_target_stops_and_missing_features_do_not(spark, data):
    _, df = data
    with pytest.raises(ValueError, match="target"):
        BoostedTrees(["a"], trees=1, workers=2).fit(df.withColumn("y", F.lit(None).cast("double")))
    empty = df.withColumn("a", F.lit(None).cast("double"))
    assert BoostedTrees(["a"], trees=2, depth=2, workers=2).fit(empty).predict(empty).filter("yhat is null").isEmpty()


# --- messages ---------------------------------------------------------------------------------------------


class _Counted(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.read_bytes = 0

    def read(self, n=-1):
        out = super().read(n)
        self.read_bytes += len(out)
        return out


def _messages(n=60, size=40_000):
    rng = np.random.default_rng(3)
    return [records.framed((0, k % 4, 1), (103, k), rng.bytes(size) + b"GRIB" * (k % 3)) for k in range(n)]


def test_walk_reads_headers_only_and_finds_every_message():
    found = _messages()
    body = b"junk" + b"".join(found[:30]) + b"GRIB\x00\x00\x00\x02 not one" + b"".join(found[30:])
    file = _Counted(body)
    got = list(records.walked(records._Ranges(file, len(body)), 0, len(body)))
    assert [body[s : s + n] for s, n, _, _ in got] == found
    assert [(name, level) for *_, name, level in got] == [(f"0.{k % 4}.1", f"103:{k}") for k in range(60)]
    # each stretch finds its own first message, and together they find all, once
    parts = [m for k in range(7) for m in records.walked(records._Ranges(io.BytesIO(body), len(body)), len(body) * k // 7, len(body) * (k + 1) // 7)]
    assert parts == got


def test_walk_of_headers_reads_a_hundredth():
    body = b"".join(_messages(40, 200_000))
    file = _Counted(body)
    first = records.message_length(records._Ranges(file, len(body)), 0, body[:16])
    assert first == len(records.framed((0, 0, 1), (103, 0), bytes(200_000)))
    ranges = records._Ranges(file, len(body))
    at, seen = 0, 0
    while at < len(body):
        head = ranges.read(at, records.DESCRIBED)
        at += records.message_length(ranges, at, head)
        seen += 1
    assert seen == 40 and ranges.total < len(body) / 100


def test_messages_by_index_and_by_headers(spark, tmp_path):
    rows = [(f"n{k % 4}", str(k), m) for k, m in enumerate(_messages(20, 900))]
    records.write_messages(spark.createDataFrame(rows, "name string, level string, message binary").repartition(3), str(tmp_path / "m"))
    want = sorted(rows)
    for options in ({}, {"index": "", "stretch": "3000", "codes": json.dumps({f"0.{k}.1": f"n{k}" for k in range(4)})}):
        got = [(r.name, r.level.split(":")[-1], bytes(r.message)) for r in records.read_messages(spark, str(tmp_path / "m"), **options).collect()]
        assert sorted(got) == want
    some = records.read_messages(spark, str(tmp_path / "m"), names="n1", content="false").collect()
    assert {r.name for r in some} == {"n1"} and all(r.message is None for r in some) and len(some) == 5
    assert records.payload(want[0][2])[:0] == b""


def test_last_message_of_an_index_ends_with_the_file():
    assert records.indexed("1:0:d:A:x:\n2:10:d:B:y:\n2.1:10:d:C:y:\n", 25) == [(0, 10, "A", "x"), (10, 15, "B", "y"), (10, 15, "C", "y")]


# --- grids ------------------------------------------------------------------------------------------------


def test_grid_file_and_its_slabs():
    x = np.arange(2 * 3 * 4 * 5, dtype=float).reshape(2, 3, 4, 5)
    x[1, 2, 3, 4] = np.nan
    axes = {"time": np.array([0.0, 30.0]), "lev": np.array([850.0, 500.0, 250.0]), "lat": np.arange(4.0), "lon": np.arange(5.0)}
    file = io.BytesIO(grids.classic_file(axes, datetime(2024, 1, 1, 0, 30), {"t": x, "u": -x}, {"title": "made"}))
    header = grids.read_header(file)
    assert header.facts == {"title": "made"} and header.variables["u"].dims == ["time", "lev", "lat", "lon"]
    assert grids.clock(header.variables["time"].facts, grids.axis(file, header, "time")) == [datetime(2024, 1, 1, 0, 30), datetime(2024, 1, 1, 1)]
    for t, level in itertools.product(range(2), range(3)):
        assert np.array_equal(grids.hyperslab(file, header, header.variables["u"], (t, level), slice(1, 4)), -x[t, level, 1:4], equal_nan=True)
    assert grids.in_order(axes["lev"], [250, 850]) == [2, 0]
    with pytest.raises(ValueError, match="no level"):
        grids.in_order(axes["lev"], [100])
    with pytest.raises(ValueError, match="HDF5"):
        grids.read_header(io.BytesIO(b"\x89HDF\r\n\x1a\n"))


def test_header_of_version_one_packed_values_and_units():
    name = lambda s: struct.pack(">I", len(s)) + s + bytes(-len(s) % 4)
    facts = name(b"scale_factor") + struct.pack(">IId", 6, 1, 0.5) + name(b"add_offset") + struct.pack(">IId", 6, 1, 10.0) + name(b"_FillValue") + struct.pack(">II", 3, 1) + struct.pack(">hxx", -1)
    head = b"CDF\x01" + struct.pack(">I", 0) + struct.pack(">II", 10, 1) + name(b"lat") + struct.pack(">I", 3) + bytes(8) + struct.pack(">II", 11, 1)
    one = name(b"lat") + struct.pack(">II", 1, 0) + struct.pack(">II", 12, 3) + facts
    at = len(head) + len(one) + 12
    body = head + one + struct.pack(">III", 3, 8, at) + struct.pack(">hhhxx", 2, -1, 4)
    file = io.BytesIO(body)
    header = grids.read_header(file)
    assert np.array_equal(grids.axis(file, header, "lat"), [11.0, np.nan, 12.0], equal_nan=True)
    assert grids.clock({"units": "hours since 2020-02-29 12:00"}, np.array([12.0])) == [datetime(2020, 3, 1)]
    with pytest.raises(ValueError):
        grids.clock({"units": "fortnights"}, np.zeros(1))


def test_grids_are_written_read_and_cropped(spark, tmp_path):
    rows = [(f"d{d}", datetime(2024, 1, d, h), lev, float(lat), float(lon), float(100 * d + 10 * h + lat) if lat != lon else None) for d in (1, 2) for h in (0, 6, 12) for lev in (500.0, 250.0) for lat in range(3) for lon in range(4)]
    df = spark.createDataFrame(rows, "file string, time timestamp_ntz, lev double, lat double, lon double, t double")
    grids.write_grids(df, str(tmp_path / "g"))
    got = grids.read_grids(spark, str(tmp_path / "g"), stretch="500").drop("file").collect()
    assert sorted(map(str, got)) == sorted(str(r) for r in df.drop("file").collect())
    box = grids.read_grids(spark, str(tmp_path / "g"), box="1,2,0,1", levels="250").collect()
    assert len(box) == 2 * 3 * 4 and {r.lev for r in box} == {250.0}
    with pytest.raises(Exception, match="two rows for one cell"):
        grids.write_grids(df.union(df), str(tmp_path / "h"))
    assert not [f for f in os.listdir(tmp_path / "h") if not f.startswith("_")] if (tmp_path / "h").exists() else True


# --- bundles ----------------------------------------------------------------------------------------------


def test_bundles_appear_all_at_once(spark, tmp_path):
    path = str(tmp_path / "b")
    df = spark.range(25).selectExpr("id", "cast(id as string) name", "array(cast(id as float), 1.5f) v").repartition(3)
    bundles.write_bundles(df, path, rows=4)
    names = [f for f in os.listdir(path) if f.endswith(".npz")]
    loaded = [np.load(f"{path}/{n}") for n in names]
    assert sorted(i for z in loaded for i in z["id"]) == list(range(25)) and all(z["v"].shape == (len(z["id"]), 2) for z in loaded)
    assert sorted(map(str, bundles.read_bundles(spark, path).select("id", "name", "v").collect())) == sorted(map(str, df.collect()))
    assert [r.id for r in bundles.read_bundles(spark, path, "id long").orderBy("id").collect()] == list(range(25))

    # a task that dies on the way leaves the earlier bundles as they were, and nothing else
    @F.udf("long")
    def dies(x):
        if x == 21:
            raise ValueError("killed")
        return x

    with pytest.raises(Exception, match="killed"):
        bundles.write_bundles(df.select(dies("id").alias("id"), "name", "v"), path, rows=2)
    assert sorted(f for f in os.listdir(path) if f.endswith(".npz")) == sorted(names)
    assert bundles.read_bundles(spark, path).count() == 25
    assert not [f for f, _ in stores.files_of(path, "") if "_staging" in f]  # where a task that outlives the abort may still write

    bundles.write_bundles(df.filter("id < 5"), path)
    assert bundles.read_bundles(spark, path).count() == 5
    assert sorted(os.path.basename(f) for f, _ in stores.files_of(path, ".npz")) == sorted(f for f in os.listdir(path) if f.endswith(".npz"))


def test_nulls_and_ragged_lists_are_refused(spark, tmp_path):
    with pytest.raises(Exception, match="nulls"):
        bundles.write_bundles(spark.sql("select cast(null as long) x"), str(tmp_path / "n"))
    with pytest.raises(Exception, match="different lengths"):
        bundles.write_bundles(spark.sql("select array(1) x union all select array(1, 2)").coalesce(1), str(tmp_path / "r"))


# --- configuration ----------------------------------------------------------------------------------------


def test_settings_are_read_and_missing_ones_named(spark, tmp_path):
    from quaywise.sources import configs

    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("a:\n  b: [1, two]\n  c: {d: 1.5}\n")
    config = configs.read_config(spark, str(tmp_path / "c.yaml"))
    assert configs.setting(config, "a", "b") == [1, "two"] and configs.setting(config, "a", "c", "d") == 1.5
    with pytest.raises(KeyError, match="a.c.x"):
        configs.setting(config, "a", "c", "x", "y")
    (tmp_path / "l.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        configs.read_config(spark, str(tmp_path / "l.yaml"))
