"""Hand-made cases: ties, gaps, clock changes, nulls."""

from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quaywise.functions import scalars, timeaxis
from quaywise.operators import evaluate, heads, models, panel, qc, spatial, splits, temporal
from quaywise.sources import tables


def _ts(*x):
    return datetime(2024, 1, *x)


def _frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_nearest_takes_the_earlier_of_a_tie_and_includes_the_tolerance(spark):
    left = _frame(spark, [("a", _ts(1, 3, 0)), ("a", _ts(1, 10, 0)), ("a", _ts(2, 0, 0)), ("b", _ts(1, 3))], "k string, ts timestamp_ntz")
    right = _frame(spark, [("a", _ts(1, 2, 0), 1.0), ("a", _ts(1, 4, 0), 2.0), ("a", _ts(1, 11, 30), 3.0)], "k string, ts timestamp_ntz, v double")
    got = {(r.k, r.ts): r.v for r in temporal.nearest_asof(left, right, ["k"], ["v"], 5400).collect()}
    assert got == {("a", _ts(1, 3, 0)): 1.0, ("a", _ts(1, 10, 0)): 3.0, ("a", _ts(2, 0, 0)): None, ("b", _ts(1, 3)): None}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 400), min_size=1, max_size=12), st.lists(st.integers(0, 400), min_size=1, max_size=12, unique=True), st.integers(1, 120))
def test_asof_joins_equal_pandas(spark, lefts, rights, minutes):
    base = datetime(2024, 1, 1)
    l_ = pd.DataFrame({"ts": [base + pd.Timedelta(minutes=m) for m in lefts], "i": range(len(lefts))}).sort_values("ts")
    r_ = pd.DataFrame({"ts": [base + pd.Timedelta(minutes=m) for m in sorted(rights)], "v": [float(m) for m in sorted(rights)]})
    left = spark.createDataFrame([("k", t.to_pydatetime(), int(i)) for t, i in l_.itertuples(index=False)], "k string, ts timestamp_ntz, i int")
    right = spark.createDataFrame([("k", t.to_pydatetime(), v) for t, v in r_.itertuples(index=False)], "k string, ts timestamp_ntz, v double")
    want = pd.merge_asof(l_, r_, on="ts", direction="nearest", tolerance=pd.Timedelta(minutes=minutes)).set_index("i").v
    got = temporal.nearest_asof(left, right, ["k"], ["v"], minutes * 60).toPandas().set_index("i").v
    # of two at the same distance the earlier
    for i in got.index:
        a, b = got[i], want[i]
        assert (a != a) == (b != b) and (a != a or a == b or abs(a - lefts[i]) == abs(b - lefts[i]) and a < b)
    want = pd.merge_asof(l_, r_, on="ts").set_index("i").v
    got = temporal.backward_asof(left, right, ["k"], ["v"], bucket_s=1800).toPandas().set_index("i").v
    assert got.sort_index().fillna(-1).tolist() == want.sort_index().fillna(-1).tolist()


def test_exact_lag_is_by_time_not_by_row(spark):
    df = _frame(spark, [("z", _ts(1, h), float(h)) for h in (0, 1, 3)], "zone string, ts timestamp_ntz, y double")
    got = {r.ts.hour: r.lag for r in temporal.exact_lag(df, ["zone"], "y", {"lag": 3600}).collect()}
    assert got == {0: None, 1: 0.0, 3: None}


def test_interpolation_keeps_leading_gap_and_holds_the_end(spark):
    df = _frame(spark, [("z", _ts(d, 0), v) for d, v in [(1, None), (2, 1.0), (3, None), (4, 3.0), (5, None)]], "zone string, ts timestamp_ntz, v double")
    got = [r.filled for r in temporal.interpolate(df, ["zone"], "v").orderBy("ts").collect()]
    assert got == [None, 1.0, 2.0, 3.0, 3.0]


def test_latest_known_and_preferred(spark):
    v = _frame(spark, [(1, 1, 10.0), (1, 2, 20.0), (1, 3, 30.0)], "k int, made int, x double")
    assert temporal.latest_known(v, ["k"], "x", "made", F.col("made") < 3).head().x == 20.0
    leads = _frame(spark, [(1, 27, 5.0), (2, 24, 6.0), (2, 27, 7.0), (3, 30, 8.0)], "k int, lead int, x double")
    assert {r.k: r.x for r in temporal.preferred(leads, ["k"], "x", "lead", [24, 27]).collect()} == {1: 5.0, 2: 6.0}


def test_repeated_and_missing_hours(spark):
    rows = [(datetime(2024, 11, 3, 1, 30), False), (datetime(2024, 11, 3, 1, 30), True), (datetime(2024, 3, 10, 2, 30), False)]
    df = _frame(spark, rows, "t timestamp_ntz, again boolean")
    got = [r.u for r in df.select(timeaxis.local_to_utc(F.col("t"), "America/Chicago", F.col("again")).alias("u")).collect()]
    assert got == [datetime(2024, 11, 3, 6, 30), datetime(2024, 11, 3, 7, 30), None]


def test_offsets_and_weeks(spark):
    df = _frame(spark, [("2024-03-10T00:30:00-05:00",), ("junk",), (None,), ("2024-12-30T12:00:00Z",)], "s string")
    got = [r[0] for r in df.select(timeaxis.parse_offset(F.col("s"))).collect()]
    assert got == [datetime(2024, 3, 10, 5, 30), None, None, datetime(2024, 12, 30, 12)]
    assert df.select(timeaxis.iso_week(timeaxis.parse_offset(F.col("s")))).collect()[3][0] == "2025-1"


def test_rounding_ties_go_to_the_even_step(spark):
    df = _frame(spark, [(_ts(1, 1, 30),), (_ts(1, 4, 30),), (_ts(1, 2, 0),)], "t timestamp_ntz")
    assert [r[0].hour for r in df.select(timeaxis.round_to(F.col("t"), 3)).collect()] == [0, 6, 3]


def test_holidays_and_weekdays(spark):
    days = timeaxis.federal_holidays(2021, 2021)
    assert date(2021, 7, 5) in days and date(2021, 11, 25) in days and date(2021, 6, 18) in days
    df = _frame(spark, [(date(2024, 1, 10),), (date(2024, 1, 11),)], "d date")
    assert [r[0] for r in df.select(timeaxis.previous_weekday(F.col("d"), 2)).collect()] == [date(2024, 1, 3), date(2024, 1, 10)]


def test_average_percent_rank(spark):
    df = _frame(spark, [("g", i, v) for i, v in enumerate([3, 1, 3, 2, 5, 3])], "g string, i int, v int")
    got = [round(r.p, 4) for r in df.withColumn("p", panel.percent_rank_average("v", ["g"])).orderBy("i").collect()]
    assert got == [0.6667, 0.1667, 0.6667, 0.3333, 1.0, 0.6667]


def test_rolling_frame_is_open_on_the_left(spark):
    df = _frame(spark, [("z", _ts(d, 0), float(d)) for d in (1, 2, 3)], "zone string, ts timestamp_ntz, y double")
    got = [r.m for r in panel.rolling_mean(df, ["zone"], "y", 86400, "m").orderBy("ts").collect()]
    assert got == [1.0, 2.0, 3.0]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 200), st.one_of(st.none(), st.integers(-5, 5))), min_size=1, max_size=40), st.integers(1, 90), st.integers(0, 4))
def test_rolling_quantile_equals_pandas(spark, points, minutes, least):
    rows = [("k", datetime(2024, 1, 1) + timedelta(minutes=m), None if v is None else float(v), i) for i, (m, v) in enumerate(points)]
    got = {r.i: r.q for r in panel.rolling_quantile(spark.createDataFrame(rows, "k string, ts timestamp_ntz, y double, i int"), ["k"], "y", 60 * minutes, 0.3, least, "q").collect()}
    for _, ts, _, i in rows:
        frame = [v for _, t, v, _ in rows if v is not None and ts - timedelta(minutes=minutes) < t <= ts]
        assert got[i] is None if len(frame) < max(least, 1) else abs(got[i] - np.quantile(frame, 0.3)) < 1e-9


def test_ordered_values_split_and_shrink():
    rng, held, plain = np.random.default_rng(5), panel.OrderedValues(), []
    for k in range(6000):
        if plain and rng.random() < (0.2 if k < 3000 else 0.8):
            x = plain.pop(rng.integers(len(plain)))
            held.remove(x)
        else:
            x = float(rng.integers(0, 300))
            held.add(x)
            plain.append(x)
        if k % 500 == 0 and plain:
            assert [held.at(j) for j in range(held.size)] == sorted(plain)


def test_sums_need_all_parts(spark):
    df = _frame(spark, [(1, "a", 1.0), (1, "b", None), (2, "a", 1.0), (2, "b", 2.0)], "k int, p string, v double")
    assert {r.k: r.s for r in df.groupBy("k").agg(panel.sum_at_least(F.col("v"), 2).alias("s")).collect()} == {1: None, 2: 3.0}


def test_records_at_any_depth(spark):
    raw = ['{"w": {"list": [{"k": 1}, {"k": 2}]}}', '{"k": 3}', "[]", "not json", None]
    df = _frame(spark, list(enumerate(raw)), "i int, raw string")
    assert [r.i for r in tables.find_records(df, "raw", "k").orderBy("i").collect()] == [0, 0, 1]
    one = df.filter("i = 1").select(F.explode(tables.one_or_many(F.col("raw"), "struct<k:int>")).alias("r")).head()
    assert one.r.k == 3


def test_numbers_text_and_nan(spark):
    df = _frame(spark, [("1,234.5", float("nan")), ("n/a", 1.0)], "s string, x double")
    assert [r[0] for r in df.select(tables.number(F.col("s"))).collect()] == [1234.5, None]
    assert [r.x for r in tables.nan_to_null(df).collect()] == [None, 1.0]
    html = _frame(spark, [("<p>a &amp; b</p><script>x</script>\n c",)], "h string")
    assert html.select(tables.plain_text(F.col("h"))).head()[0] == "a & b c"


def test_unfilled_numbers_stop_the_query(spark):
    df = _frame(spark, [(1, None, 2.0), (2, 1.0, None)], "k int, a double, b double")
    with pytest.raises(Exception, match="missing"):
        scalars.check_filled(df, {"a": 0.0}).collect()


def test_year_ahead_needs_two_years(spark):
    df = _frame(spark, [(_ts(1, 0),)], "ts timestamp_ntz")
    with pytest.raises(Exception, match="two years"):
        splits.year_ahead(df).collect()


def test_linear_and_ridge_equal_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 2)) * [1, 5]
    y = x @ [2.0, -1.0] + 3 + rng.normal(size=60)
    df = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, y double")
    for penalty in (0.0, 4.0):
        m = models.Linear(["a", "b"], penalty).fit(df)
        z = (x - x.mean(0)) / x.std(0)
        w = np.linalg.solve(z.T @ z + penalty * np.eye(2), z.T @ (y - y.mean()))
        assert np.allclose(m.coefficients, w / x.std(0))


def test_features_with_the_target_are_refused():
    with pytest.raises(ValueError):
        models.feature_sets({"a": ["x", "y"]}, [["a"]], "y")


def test_resampled_intervals_follow_the_table_of_draws(spark):
    rng = np.random.default_rng(1)
    rows = [(g, f"2024-{w}", float(v), bool(v > 0)) for g, weeks in (("g", range(1, 9)), ("h", (2, 5))) for w in weeks for v in rng.normal(size=5)]
    df = spark.createDataFrame(rows, "g string, week string, d double, up boolean")
    weights = evaluate.resampling_weights(df, "week", draws=300)
    table = weights.toPandas().pivot(index="draw", columns="week", values="weight").fillna(0)
    assert (table.sum(axis=1) == 8).all() and len(table) == 300 and table.to_numpy().std() > 0.8
    p = pd.DataFrame(rows, columns=["g", "week", "d", "up"])
    p["e_a"], p["e_b"] = -p.d, 0.0
    for g, part in p.groupby("g"):
        of = lambda x: x.groupby("week").d.agg(["sum", "count"]).reindex(table.columns).fillna(0)  # noqa: B023, E731
        ratio = lambda x: (table @ of(x)["sum"]) / (table @ of(x)["count"])  # noqa: B023, E731
        got = evaluate.resampled(df, weights, "week", ["g"], {"m": (F.col("d"), F.lit(1.0))}).filter(F.col("g") == g).head()
        assert np.allclose([got.m, got.m_lo, got.m_hi], [part.d.mean(), *np.nanpercentile(ratio(part), [2.5, 97.5])])
        pairs = df.withColumns({"e_a": -F.col("d"), "e_b": F.lit(0.0)})
        split = evaluate.gain_split(pairs, "up", weights, "week", ["g"]).filter(F.col("g") == g).head()
        both = ratio(part[part.up]) - ratio(part[~part.up])
        assert np.allclose([split.high_minus_low_lo, split.high_minus_low_hi], np.nanpercentile(both, [2.5, 97.5])) and split.hours_high == part.up.sum()


def test_days_of_too_few_samples_have_no_regime(spark):
    rows = [(datetime(y, 1, d, h), float(d + 10 * (y == 2001) * (d == 9))) for y in (2000, 2001) for d in range(1, 13) for h in range(6 if d != 4 else 5)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, x double")
    got = {r.day: r for r in evaluate.daily_regimes(df, [], "x", spark.createDataFrame([(2001,)], "test_year int")).collect()}
    assert len(got) == 22 and date(2000, 1, 4) not in got and got[date(2000, 1, 5)].swing is None
    assert got[date(2001, 1, 1)].regime == "cold" and got[date(2001, 1, 9)].regime == "hot" and got[date(2001, 1, 10)].regime == "ramp" and got[date(2001, 1, 5)].regime == "normal"


def test_pca_equals_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6))
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "i int, v array<double>")
    pca = spatial.Pca(df, "v", 2)
    z = (x - x.mean(0)) / x.std(0)
    _, s, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(pca.share, (s**2 / (s**2).sum())[:2])
    got = np.array([r.pc for r in pca.transform(df, "v").orderBy("i").collect()])
    assert np.allclose(np.abs(got), np.abs(z @ vt[:2].T))


def test_missing_and_conflicts(spark):
    a, b = _frame(spark, [(1,), (2,)], "k int"), _frame(spark, [(2,)], "k int")
    assert [r.k for r in qc.missing(a, b, ["k"]).collect()] == [1]
    q = _frame(spark, [(1, 1.0), (1, 1.001), (2, 1.0), (2, 2.0)], "k int, v double")
    assert [r.k for r in qc.conflicting(q, ["k"], "v", 0.005).collect()] == [2]


def test_rolling_frames_reach_over_bucket_borders(spark):
    rng = np.random.default_rng(0)
    hours = np.sort(rng.choice(3000, 900, replace=False))
    values = rng.normal(size=900)
    df = spark.createDataFrame([("z", _ts(1) + timedelta(hours=int(h)), float(v)) for h, v in zip(hours, values)], "zone string, ts timestamp_ntz, y double")
    want = pd.Series(values, index=pd.to_datetime([_ts(1) + timedelta(hours=int(h)) for h in hours]))
    got = panel.rolling_mean(df, ["zone"], "y", 86400, "m").toPandas().sort_values("ts")
    assert len(got) == 900 and np.allclose(got.m, want.rolling("24h").mean())
    got = panel.rolling_quantile(df, ["zone"], "y", 3 * 86400, 0.9, 5, "q").toPandas().sort_values("ts")
    assert np.allclose(got.q.astype(float), want.rolling("72h", min_periods=5).quantile(0.9), equal_nan=True)


def test_fills_reach_over_buckets_without_data(spark):
    rows = [("z", 0, None), ("z", 1, 1.0), ("z", 400, None), ("z", 900, 5.0), ("z", 950, None), (None, 3, 2.0), (None, 700, None)]
    df = spark.createDataFrame([(k, _ts(1) + timedelta(hours=h), v) for k, h, v in rows], "zone string, ts timestamp_ntz, v double")
    got = {(r.zone, int((r.ts - _ts(1)).total_seconds() // 3600)): r.filled for r in temporal.forward_fill(df, ["zone"], "v", 86400).collect()}
    assert got == {("z", 0): None, ("z", 1): 1.0, ("z", 400): 1.0, ("z", 900): 5.0, ("z", 950): 5.0, (None, 3): 2.0, (None, 700): 2.0}
    line = {int((r.ts - _ts(1)).total_seconds() // 3600): r.filled for r in temporal.interpolate(df.filter("zone = 'z'"), ["zone"], "v", 86400).collect()}
    assert abs(line[400] - (1 + 4 * 399 / 899)) < 1e-9 and line[0] is None and line[950] == 5.0


@pytest.mark.parametrize("parts", [2, 7])
def test_ranks_over_value_ranges_equal_pandas(spark, parts):
    rng = np.random.default_rng(parts)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], 400), "v": rng.integers(0, 60, 400).astype(float), "i": range(400)})
    df = panel.in_value_ranges(spark.createDataFrame(pdf), "v", ["g"], parts)
    assert df.select("g", "_range").distinct().count() > 2
    got = panel.ranked(spark.createDataFrame(pdf), "v", ["g"], "r", percent=True).toPandas().sort_values("i")
    assert np.allclose(got.r, pdf.groupby("g").v.rank(pct=True))
    worst = panel.worst_share(spark.createDataFrame(pdf), ["g"], "v", 0.1, "i").toPandas()
    for g, own in pdf.groupby("g"):
        top = own.sort_values(["v", "i"], ascending=[False, True]).head(round(0.1 * len(own)))
        assert set(worst[worst.g == g].i) == set(top.i)


def test_days_to_the_nearest_known_day(spark):
    rows = [("z", d, d in (3, 20)) for d in (1, 3, 9, 12, 20, 28)] + [("y", 5, False)]
    df = spark.createDataFrame([(z, date(2024, 1, d), k) for z, d, k in rows], "zone string, day date, known boolean")
    got = {(r.zone, r.day.day): r.distance for r in temporal.days_to_nearest(df, ["zone"], "known").collect()}
    assert got == {("z", 1): 2, ("z", 3): 0, ("z", 9): 6, ("z", 12): 8, ("z", 20): 0, ("z", 28): 8, ("y", 5): None}


def _regression(spark, n=300, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) * [1, 5, 0.2, 3] + [0, 2, 1, -4]
    y = 3 + x @ [1.5, 0.0, 4.0, -0.5] + rng.normal(size=n)
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(y=y, fold=np.arange(n) % 5)
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("l1", [0.0, 0.5, 1.0])
def test_cross_validation_from_sums_equals_fits_of_the_rows(spark, l1):
    pdf, df = _regression(spark)
    names, alphas = list("abcd"), [0.001, 0.1, 1.0, 5.0]

    def plain(train, alpha):
        """Proximal gradient steps on the rows."""
        x, y = train[names].to_numpy(), train.y.to_numpy()
        m, s = x.mean(0), x.std(0)
        z, b = (x - m) / s, np.zeros(4)
        for _ in range(4000):
            b = b - 0.2 * (z.T @ (z @ b - (y - y.mean())) / len(y) + alpha * (1 - l1) * b)
            b = np.sign(b) * np.maximum(np.abs(b) - 0.2 * alpha * l1, 0)
        return y.mean() - m @ (b / s), b / s

    def error(alpha):
        total = 0.0
        for k in range(5):
            i, b = plain(pdf[pdf.fold != k], alpha)
            test = pdf[pdf.fold == k]
            total += ((test.y - i - test[names].to_numpy() @ b) ** 2).sum()
        return total

    model, alpha = models.cross_validated(df, names, alphas, l1)
    assert alpha == min(alphas, key=error)
    i, b = plain(pdf, alpha)
    assert np.allclose(model.coefficients, b, atol=1e-5) and abs(model.intercept - i) < 1e-4


def test_network_gradients_and_losses(spark):
    pdf, df = _regression(spark)
    rng = np.random.default_rng(0)
    for loss, hidden in (("squared", 3), ("huber", 3), ("squared", 0)):
        net = models.Network(list("abcd"), hidden=hidden, loss=loss)
        x, y = rng.normal(size=(20, 4)), rng.normal(size=20)
        w = rng.normal(size=sum(int(np.prod(s)) for s in net._shapes()))
        value = lambda e: np.where(np.abs(e) < 1, e * e / 2, np.abs(e) - 0.5).sum() if loss == "huber" else (e * e / 2).sum()  # noqa: B023, E731

        def predicted(w, net=net, x=x, hidden=hidden):
            p = net._split(w)
            return np.tanh(x @ p[0] + p[1]) @ p[2] + p[3] if hidden else x @ p[0] + p[1]

        g = net._gradient(x, y, w)
        for k in range(len(w)):
            step = np.eye(len(w))[k] * 1e-6
            assert abs((value(predicted(w + step) - y) - value(predicted(w - step) - y)) / 2e-6 - g[k]) < 1e-4
    fitted = models.Network(list("abcd"), hidden=4, steps=30, rate=0.1).fit(df).predict(df).toPandas()
    assert ((fitted.y - fitted.yhat) ** 2).mean() < 0.5 * pdf.y.var()
    high = models.Network(list("abcd"), hidden=0, loss="quantile", level=0.9, steps=40, rate=0.1).fit(df).predict(df).toPandas()
    assert 0.8 < (high.y <= high.yhat).mean() < 0.98


def test_gram_pca_equals_an_eigenvalue_problem_of_the_rows(spark):
    x = np.random.default_rng(3).normal(size=(6, 40))
    got = spatial.gram_pca(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "k int, v array<double>"), "k", "v", 2).toPandas().sort_values("k")
    c = (x - x.mean(0)) / (x - x.mean(0)).std()
    u, s, _ = np.linalg.svd(c, full_matrices=False)
    want = u[:, :2] * s[:2]
    assert np.allclose(np.abs(got[["pc0", "pc1"]]), np.abs(want), atol=1e-8)


def test_gram_pca_by_blocks_and_by_iteration(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(23, 3)) @ rng.normal(size=(3, 30)) * [5.0] * 1 + rng.normal(0, 0.05, (23, 30)) + np.repeat([0.0, 50.0], 15)
    x[:, 15:] *= 9
    df = spark.createDataFrame([(i, r.tolist(), i < 19) for i, r in enumerate(x)], "k int, v array<double>, own boolean")
    t = x[:19]
    sd = np.repeat(np.sqrt(t.reshape(19, 2, 15).var(axis=0).mean(axis=1)), 15)
    _, _, vt = np.linalg.svd((t - t.mean(0)) / sd, full_matrices=False)
    want = ((x - t.mean(0)) / sd) @ vt[:3].T
    for how in ({"block": 4}, {"most": 8}):
        got = spatial.gram_pca(df, "k", "v", 3, fields=2, train="own", **how).toPandas().sort_values("k")[["pc0", "pc1", "pc2"]].to_numpy()
        assert np.allclose(np.abs(got), np.abs(want), atol=1e-5), how
        assert (got[:19][np.abs(got[:19]).argmax(axis=0), range(3)] > 0).all()
    with pytest.raises(ValueError):
        spatial.gram_pca(df.filter("k < 0"), "k", "v", 1)


def test_interval_join_meets_each_pair_once(spark):
    rng = np.random.default_rng(6)
    day = lambda m: datetime(2024, 1, 1) + timedelta(minutes=int(m))
    make = lambda n: [(int(rng.integers(3)), i, day(s), day(s + rng.integers(0, 5000))) for i, s in enumerate(rng.integers(0, 20000, n))]
    a, b = make(60), make(70)
    left = spark.createDataFrame(a, "k int, i int, s timestamp_ntz, e timestamp_ntz")
    right = spark.createDataFrame(b, "k int, j int, s2 timestamp_ntz, e2 timestamp_ntz")
    joined = temporal.interval_join(left, right, ["k"], ("s", "e"), ("s2", "e2"), 86400)
    assert "NestedLoop" not in joined._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in joined._jdf.queryExecution().executedPlan().toString()
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and max(x[2], y[2]) < min(x[3], y[3]))
    assert sorted((r.i, r.j) for r in joined.collect()) == want and want


def test_union_of_overlapping_parts_and_holes(spark):
    square = lambda x, y, a: [[x, y], [x + a, y], [x + a, y + a], [x, y + a], [x, y]]
    tilted = [[0.0, 1.0], [1.0, 0.0], [2.0, 1.0], [1.0, 2.0], [0.0, 1.0]]
    rows = [("z", 0, 0, square(0.0, 0.0, 2.0)), ("z", 1, 0, square(1.0, 1.0, 2.0)), ("z", 2, 0, square(10.0, 0.0, 4.0)), ("z", 2, 1, square(11.0, 1.0, 1.0)), ("t", 0, 0, tilted), ("t", 1, 0, square(0.0, 0.0, 1.0)), ("e", 0, 0, [])]
    rings = spark.createDataFrame(rows, "zone string, part int, ring int, points array<array<double>>")
    got = {r.zone: r.area for r in spatial.union_areas(rings).collect()}
    assert abs(got["z"] - (7 + 15)) < 1e-9 and abs(got["t"] - 2.5) < 1e-9 and got["e"] == 0
    points = spark.createDataFrame([(1.5, 1.5), (11.5, 1.5), (10.5, 0.5), (-1.0, 0.0), (2.9, 2.9)], "x double, y double")
    assert sorted((r.x, r.zone) for r in spatial.points_in_polygons(points, rings.filter("zone = 'z'"), "x", "y", 0.7).collect()) == [(1.5, "z"), (2.9, "z"), (10.5, "z")]


@pytest.mark.parametrize("kind", ["attention", "convolution"])
def test_gradients_of_heads_equal_differences(kind):
    rng = np.random.default_rng(2)
    head = heads.SpatialHead("v", (3, 2), kind, units=2)
    head.channels = 3
    x, y = rng.normal(size=(5, 6, 3)), rng.normal(size=5)
    w = np.concatenate([rng.normal(0, 0.5, s).ravel() for s in head._shapes()])
    loss = lambda v: 0.5 * ((head.output(x, v)[0] - y) ** 2).sum()
    g = head.gradient(x, y, w)
    for k in range(len(w)):
        d = np.zeros(len(w))
        d[k] = 1e-6
        assert abs((loss(w + d) - loss(w - d)) / 2e-6 - g[k]) < 1e-5


def test_a_head_finds_the_token_that_matters(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4, 2))
    y = x[:, :, 1].max(axis=1)
    df = spark.createDataFrame([(r.ravel().tolist(), float(v)) for r, v in zip(x, y)] + [(None, 1.0)], "v array<double>, y double")
    head = heads.SpatialHead("v", (2, 2), "attention", steps=250, workers=2).fit(df)
    got = head.predict(df).filter("v is not null").toPandas()
    assert ((got.y - got.yhat) ** 2).mean() < 0.35 * got.y.var() and head.predict(df).filter("yhat is null").count() == 1


def test_fits_read_their_rows_block_by_block(spark):
    df = spark.range(0, 5000, 1, 3).select((F.col("id") % 7).cast("double").alias("x"))

    def held(batches):
        return np.concatenate([b.column(0).to_numpy() for b in batches])

    def gradient(x, w):
        assert 0 < len(x) <= heads.BLOCK
        return np.array([(w[0] - x).sum()]), len(x)

    x = np.arange(5000) % 7.0
    want = heads.adam(np.zeros(1), lambda w: np.array([(w[0] - x).mean()]), 5, 0.5)
    for workers in (None, 2):
        assert np.allclose(heads.fitted_in_blocks(df, held, gradient, np.zeros(1), 5, 0.5, workers), want)
    assert heads.fitted_in_blocks(df.filter("x > 9"), held, gradient, np.ones(1), 2, 0.5, None)[0] == 1


def test_numbers_in_order_and_runs_that_come_apart(spark):
    df = _frame(spark, [(i * 7 % 50, i) for i in range(200)], "v int, k int")
    got = {r.k: r.n for r in panel.numbered(df, "v", "k", "n").collect()}
    assert [got[k] for _, k in sorted((i * 7 % 50, i) for i in range(200))] == list(range(200))
    a = _frame(spark, [("z", k) for k in range(9)] + [("y", 1)], "g string, k int")
    r = {x.g: x for x in qc.reconcile_order(a, a.filter("not (g = 'z' and k = 4)"), ["g"], "k").collect()}
    assert (r["z"].rows_a, r["z"].rows_b, r["z"].same_place, r["z"].first_off) == (9, 8, 4, 5) and r["y"].first_off is None


def test_a_stamp_off_the_hour_stops_the_query(spark):
    df = _frame(spark, [(_ts(1, 3),), (_ts(1, 4, 30),)], "ts timestamp_ntz")
    with pytest.raises(Exception, match="off the hour"):
        timeaxis.on_the_hour(df, "ts").collect()
    assert timeaxis.on_the_hour(df.filter("minute(ts) = 0"), "ts").count() == 1


def test_boxes_snap_to_cells_and_patches():
    assert spatial.snap_box((41.2, 43.6, -74.2, -70.9), (40.0, -75.0), (0.5, 0.625)) == (2, 7, 1, 7)
    assert spatial.snap_box((40.0, 41.5, -75.0, -73.125), (40.0, -75.0), (0.5, 0.625), 2) == (0, 3, 0, 3)
    with pytest.raises(ValueError):
        spatial.snap_box((40.0, 41.0, -75.0, -73.125), (40.0, -75.0), (0.5, 0.625), 2)


def test_scans_stop_on_other_places_and_missing_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text('{"id": 1, "place": "A"}\n{"id": 2\n{"id": 3, "place": "B"}\n')
    index = spark.createDataFrame([("a", "A"), ("b", "B")], "path string, expected string")
    good, bad = tables.driven_scan(spark, index, f"file://{tmp_path}", "id long, place string")
    assert {(r.path, r.reason, r.n) for r in bad.collect()} == {("a", "unreadable record", 1), ("b", "no file", 1)} and good.count() == 2
    with pytest.raises(Exception, match="a record of B in a file of A"):
        good.select(tables.same_place(F.col("expected"), F.col("place"), F.col("id"))).collect()
    with pytest.raises(ValueError):
        tables.driven_scan(spark, index.filter("path = 'b'"), f"file://{tmp_path}", "id long, place string")


def test_incomplete_keys_stop_and_empty_blocks_go(spark):
    days = spark.createDataFrame([(1,), (2,), (3,)], "day int")
    qc.require_complete(days, days, ["day"])
    with pytest.raises(ValueError, match=r"\(2,\)"):
        qc.require_complete(days, days.filter("day <> 2"), ["day"])
    df = spark.createDataFrame([(1, None, None), (2, 3, None)], "k int, a int, b int")
    left, gone = qc.drop_empty(df, {"first": ["a"], "second": ["b"]})
    assert left.columns == ["k", "a"] and gone == ["second"]


def test_waits_that_servers_ask_for():
    from quaywise.sources import remote

    assert remote.asked_wait("7", 0.0) == 7 and remote.asked_wait("Thu, 01 Jan 1970 00:01:40 GMT", 40.0) == 60
    assert remote.asked_wait("Thu, 01 Jan 1970 00:00:10 GMT", 40.0) == 0 and remote.asked_wait(None, 0.0) is None and remote.asked_wait("soon", 0.0) is None


def test_fetching_tries_again_and_waits_as_asked(spark):
    import http.server
    import threading

    from quaywise.sources import remote

    answers, waits = {"/busy": [429, 503, 200], "/gone": [404], "/down": [500] * 9}, []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            left = answers[self.path]
            status = left.pop(0) if len(left) > 1 else left[0]
            self.send_response(status)
            if status == 429:
                self.send_header("Retry-After", "7")
            self.end_headers()
            self.wfile.write(b"body")

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    root = f"http://127.0.0.1:{server.server_port}"
    try:
        assert remote.retrieve(f"{root}/busy", pause=0.5, sleep=waits.append) == b"body" and waits == [7.0, 1.0]
        with pytest.raises(OSError):
            remote.retrieve(f"{root}/gone", sleep=waits.append)
        assert len(waits) == 2
        rows = remote.retrieve_all(spark.createDataFrame([(f"{root}/busy",), (f"{root}/gone",)], "url string").coalesce(1)).collect()
        assert [(bytes(r.body) if r.body else None, bool(r.error)) for r in rows] == [(b"body", False), (None, True)]
        with pytest.raises(Exception, match="one after another"):
            remote.retrieve_all(spark.createDataFrame([(f"{root}/down",)] * 3, "url string").coalesce(1), most_failures=2, attempts=1).collect()
    finally:
        server.shutdown()
    asked = []
    found = remote.first_day(lambda d: asked.append(d) or d >= date(2021, 5, 17), date(2015, 1, 1), date(2024, 12, 31))
    assert found == date(2021, 5, 17) and len(asked) < 15
    assert remote.first_day(lambda d: False, date(2020, 1, 1), date(2020, 2, 1)) is None


def test_block_interval_covers_the_mean(spark):
    df = spark.createDataFrame([("g", w, float(v)) for w, v in [(1, 1), (1, 3), (2, 5), (3, 3), (3, 1)]], "g string, w int, v double")
    r = evaluate.block_interval(df, "w", "v", ["g"]).first()
    sums, n = np.array([4.0, 5.0, 4.0]), np.array([2, 1, 2])
    se = np.sqrt(((sums - 2.6 * n) ** 2).sum() * 3 / 2) / 5
    assert abs(r["mean"] - 2.6) < 1e-12 and abs(r.hi - 2.6 - 1.959964 * se) < 1e-9 and r.blocks == 3


def test_exact_quantiles_of_large_groups_equal_numpy(spark):
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 700), "v": np.round(rng.normal(size=700), 2)})
    pdf.loc[::50, "v"] = np.nan
    df = spark.createDataFrame([(g, None if v != v else float(v)) for g, v in pdf.itertuples(index=False)], "g string, v double")
    for q in (0.0, 0.3, 0.5, 0.99, 1.0):
        got = {r.g: r.q for r in panel.exact_quantile(df, "v", ["g"], q, "q").collect()}
        assert len(got) == 3 and all(abs(got[g] - np.quantile(own.v.dropna(), q)) < 1e-9 for g, own in pdf.groupby("g", dropna=False) for g in [None if g != g else g])
