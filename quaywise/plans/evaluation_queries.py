"""Queries: splits, models, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.timeaxis import iso_week, month_id
from ..operators import evaluate as ev
from ..operators import models as mo
from ..operators import splits as sp
from ..operators.boosting import BoostedTrees
from ..operators.heads import SpatialHead
from ..operators.panel import quantile_bins, ranked
from ..sources.tables import table
from .common import D, H, M, P, PAIR, daily, hourly, prediction_log, rounded, split_panel, stored
from .registry import query

ERR = "count(*) AS n, round(avg(abs(yhat - y)), 6) AS mae, round(quantile_cont(abs(yhat - y), 0.5), 6) AS median_ae, round(sqrt(avg(power(yhat - y, 2))), 6) AS rmse, round(1 - sum(power(yhat - y, 2)) / (count(*) * var_pop(y)), 6) AS r2, round(avg(yhat - y), 6) AS bias"
ERRS = ("mae", "median_ae", "rmse", "r2", "bias")
WEEK = "concat(CAST(isoyear(ts) AS VARCHAR), '-', CAST(week(ts) AS VARCHAR))"


@query("flagship_errors_by_zone", f"WITH {M} SELECT feature_set, zone, {ERR} FROM log GROUP BY 1, 2")
def flagship(spark, sf):
    """Hourly panel, blocked split, training-only models, errors by zone."""
    return rounded(ev.errors_by(stored(prediction_log(spark, sf)), ["feature_set", "zone"]), *ERRS)


def _split_counts(df):
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 2).alias("y"))


@query("spl1_year_ahead", f"WITH {D} SELECT CASE WHEN year(ts) = (SELECT max(year(ts)) FROM d) THEN 'test' ELSE 'train' END AS split, count(*) AS n, round(sum(y), 2) AS y FROM d GROUP BY 1")
def spl1(spark, sf):
    return _split_counts(sp.year_ahead(daily(spark, sf)))


@query("spl2_chronological", f"WITH {D} SELECT CASE WHEN year(ts) <> (SELECT max(year(ts)) FROM d) THEN 'unused' WHEN month(ts) <= 8 THEN 'train' WHEN month(ts) = 9 THEN 'val' ELSE 'test' END AS split, count(*) AS n, round(sum(y), 2) AS y FROM d GROUP BY 1")
def spl2(spark, sf):
    return _split_counts(sp.chronological(daily(spark, sf)))


@query("spl3_blocked", f"WITH {P} SELECT split, count(*) AS n, round(sum(y), 2) AS y FROM p GROUP BY 1")
def spl3(spark, sf):
    return _split_counts(split_panel(spark, sf))


@query("spl4_rolling_origin", f"WITH {D} SELECT CASE WHEN year(ts) < 1999 THEN 'train' WHEN year(ts) = 1999 THEN 'test' ELSE 'unused' END AS split, count(*) AS n, round(sum(y), 2) AS y FROM d GROUP BY 1")
def spl4(spark, sf):
    return _split_counts(daily(spark, sf).withColumn("split", sp.rolling_origin("ts", 1999)))


@query("spl5_exclusion", f"WITH {P} SELECT CASE WHEN split = 'train' AND CAST(ts AS DATE) BETWEEN '2024-01-05' AND '2024-01-08' THEN 'unused' ELSE split END AS split, count(*) AS n, round(sum(y), 2) AS y FROM p GROUP BY 1")
def spl5(spark, sf):
    return _split_counts(hourly(spark, sf).withColumn("split", sp.excluded(sp.blocked(), "ts", "2024-01-05", "2024-01-08")))


FOLDS = D + ", f AS (SELECT *, CAST((dense_rank() OVER (ORDER BY year(ts) * 12 + month(ts)) - 1) % 5 AS INT) AS fold FROM d)"


@query("spl6_month_folds", f"WITH {FOLDS} SELECT fold, count(*) AS n, round(sum(y), 2) AS y FROM f GROUP BY 1")
def spl6(spark, sf):
    return sp.month_folds(daily(spark, sf)).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 2).alias("y"))


@query("spl7_buffered_fold", f"WITH {FOLDS} SELECT zone, count(*) AS n, round(sum(y), 2) AS y FROM f WHERE fold NOT IN (0, 1) AND NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT ts AS held FROM f WHERE fold = 0) x WHERE abs(date_diff('day', x.held, f.ts)) <= 7) GROUP BY 1")
def spl7(spark, sf):
    return sp.buffered_train(sp.month_folds(daily(spark, sf)), 0, 7).groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 2).alias("y"))


@query("spl8_recent_months", f"WITH {D}, m AS (SELECT DISTINCT year(ts) * 12 + month(ts) AS m FROM d ORDER BY 1 DESC LIMIT 6) SELECT zone, count(*) AS n, round(sum(y), 2) AS y FROM d WHERE year(ts) * 12 + month(ts) IN (SELECT m FROM m) GROUP BY 1")
def spl8(spark, sf):
    return sp.recent_months(daily(spark, sf), 6).groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 2).alias("y"))


@query("spl8_random_months", f"WITH {D}, m AS (SELECT m FROM (SELECT DISTINCT year(ts) * 12 + month(ts) AS m FROM d) ORDER BY md5('3|' || CAST(m AS VARCHAR)) LIMIT 6) SELECT zone, count(*) AS n, round(sum(y), 2) AS y FROM d WHERE year(ts) * 12 + month(ts) IN (SELECT m FROM m) GROUP BY 1")
def spl8_random(spark, sf):
    return sp.random_months(daily(spark, sf), 6, 3).groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 2).alias("y"))


@query("spl9_training_times", f"WITH {P} SELECT DISTINCT ts FROM h WHERE ts IN (SELECT ts FROM p WHERE split = 'train')")
def spl9(spark, sf):
    p = split_panel(spark, sf)
    return sp.training_times(p, p.select("ts").distinct())


@query("mod11_persistence", f"WITH {H} SELECT a.zone, count(*) AS n, round(avg(abs(b.y - a.y)), 6) AS mae FROM h a JOIN h b ON a.zone = b.zone AND b.ts = a.ts - INTERVAL 24 HOUR GROUP BY 1")
def mod11_persistence(spark, sf):
    p = mo.persistence(hourly(spark, sf), ["zone"], 86400).dropna(subset=["yhat"])
    return p.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("yhat") - F.col("y"))), 6).alias("mae"))


@query("mod11_bias_corrected", f"WITH {P}, f AS (SELECT p.*, q.y AS fc FROM p JOIN p q ON p.zone = q.zone AND q.ts = p.ts - INTERVAL 24 HOUR), b AS (SELECT zone, hour(ts) AS hr, avg(fc - y) AS bias FROM f WHERE split = 'train' GROUP BY 1, 2) SELECT f.zone, f.ts, round(f.fc - coalesce(b.bias, 0), 9) AS yhat FROM f LEFT JOIN b ON f.zone = b.zone AND hour(f.ts) = b.hr WHERE split = 'test'")
def mod11_bias(spark, sf):
    p = mo.persistence(split_panel(spark, sf), ["zone"], 86400, name="fc").dropna(subset=["fc"]).withColumn("hr", F.hour("ts"))
    return rounded(mo.bias_corrected(p, ["zone", "hr"], "fc").filter("split = 'test'").select("zone", "ts", "yhat"), "yhat", digits=9)


def _features(spark, sf):
    from ..operators.temporal import exact_lag

    p = exact_lag(split_panel(spark, sf), ["zone"], "y", {"lag24": 86400, "lag48": 172800})
    return p.withColumns({"hour": F.hour("ts").cast("double"), "dow": F.weekday("ts").cast("double")}).dropna()


@query("mod_ols", f"WITH {P}, f AS (SELECT p.*, q.y AS lag24 FROM p JOIN p q ON p.zone = q.zone AND q.ts = p.ts - INTERVAL 24 HOUR), c AS (SELECT regr_slope(y, lag24) AS s, regr_intercept(y, lag24) AS i FROM f WHERE split = 'train') SELECT zone, ts, round(i + s * lag24, 5) AS yhat FROM f, c WHERE split = 'test'")
def mod_ols(spark, sf):
    p = mo.persistence(split_panel(spark, sf), ["zone"], 86400, name="lag24").dropna(subset=["lag24"])
    return rounded(mo.Linear(["lag24"]).fit(p.filter("split = 'train'")).predict(p).filter("split = 'test'").select("zone", "ts", "yhat"), "yhat", digits=5)


FEATURES = ["lag24", "lag48", "hour", "dow"]


@query("mod6_ridge_validated")
def mod6(spark, sf):
    p = mo.ridge_by_validation(_features(spark, sf), FEATURES, [0.0, 1.0, 10.0, 100.0])
    return p.filter("split = 'test'").transform(ev.errors_by, ["zone"])


def _folds(spark, sf):
    return _features(spark, sf).filter("split = 'train'").withColumn("fold", F.pmod(F.day("ts"), F.lit(5)))


@query("mod6_ridge_cv")
def mod6_ridge_cv(spark, sf):
    model, _ = mo.cross_validated(_folds(spark, sf), FEATURES, [0.0, 0.001, 0.01, 0.1, 1.0])
    return model.predict(_features(spark, sf)).filter("split = 'test'").transform(ev.errors_by, ["zone"])


@query("mod6_elastic_net_cv")
def mod6_elastic_net_cv(spark, sf):
    model, _ = mo.cross_validated(_folds(spark, sf), FEATURES, [0.001, 0.01, 0.1, 1.0], l1=0.5)
    return model.predict(_features(spark, sf)).filter("split = 'test'").transform(ev.errors_by, ["zone"])


@query("mod7_network")
def mod7(spark, sf):
    p = _features(spark, sf)
    return mo.Network(FEATURES, hidden=6, steps=150).fit(p.filter("split = 'train'")).predict(p).filter("split = 'test'").transform(ev.errors_by, ["zone"])


def _tokens(spark, sf):
    """Embeddings as grids of 4 x 4 tokens, with the label as target; every fifth vector is held out."""
    return table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("double").alias("y"), (F.col("vec_id") % 5 == 0).alias("held_out"))


@query("mod7_attention_head")
def mod7_attention(spark, sf):
    e = _tokens(spark, sf)
    return SpatialHead("embedding", (4, 4), "attention").fit(e.filter("not held_out")).predict(e).transform(ev.errors_by, ["held_out"])


@query("mod7_convolution_head")
def mod7_convolution(spark, sf):
    e = _tokens(spark, sf)
    return SpatialHead("embedding", (4, 4), "convolution").fit(e.filter("not held_out")).predict(e).transform(ev.errors_by, ["held_out"])


@query("mod3_quantile")
def mod3_quantile(spark, sf):
    p = _features(spark, sf)
    model = mo.Network(FEATURES, hidden=0, loss="quantile", level=0.9, steps=200, rate=0.2).fit(p.filter("split = 'train'"))
    return model.predict(p).filter("split = 'test'").groupBy("zone").agg(F.avg((F.col("y") <= F.col("yhat")).cast("double")).alias("covered"), F.count(F.lit(1)).alias("n"))


def _grown(p, **how):
    """300 trees of depth 6; 3,000 is the library's default."""
    return BoostedTrees(FEATURES, **{"trees": 300, "depth": 6, "rate": 0.05} | how).fit(p)


@query("mod1_boosted_trees")
def mod1(spark, sf):
    p = _features(spark, sf)
    return _grown(p).predict(p.filter("split = 'test'")).transform(ev.errors_by, ["zone"])


@query("mod4_early_stopping")
def mod4(spark, sf):
    """Growth ends 30 trees after the best one by the validation block; the model is cut there."""
    p = _features(spark, sf)
    model = _grown(p, patience=30)
    errors = model.predict(p.filter("split = 'test'")).transform(ev.errors_by, ["zone"])
    return errors.withColumns({"best_iteration": F.lit(model.best_iteration), "grown": F.lit(len(model.val_losses))})


@query("mod8_residual_head")
def mod8(spark, sf):
    p = sp.month_folds(_features(spark, sf).withColumn("day", F.to_date("ts"))).withColumn("fold", F.pmod(F.day("ts"), F.lit(5)))
    return mo.residual_head(p, ["hour", "dow"], ["lag24", "lag48"]).filter("split = 'test'").transform(ev.errors_by, ["zone"])


@query("mod9_stacking")
def mod9(spark, sf):
    p = _features(spark, sf).withColumn("fold", F.pmod(F.day("ts"), F.lit(5)))
    return mo.stacked(p, ["hour", "dow"], ["lag24", "lag48"]).filter("split = 'test'").transform(ev.errors_by, ["zone"])


@query("mod12_feature_lattice")
def mod12(spark, sf):
    p = _features(spark, sf)
    sets = mo.feature_sets({"calendar": ["hour", "dow"], "lags": ["lag24", "lag48"]}, [["calendar"], ["lags"], ["calendar", "lags"]], "y")
    parts = [mo.Linear(c).fit(p.filter("split = 'train'")).predict(p).filter("split = 'test'").withColumn("feature_set", F.lit(n)) for n, c in sets.items()]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.transform(ev.errors_by, ["feature_set"])


@query("evl2_mape", f"WITH {M}, z AS (SELECT feature_set, zone, 100 * avg(abs((yhat - y) / y)) AS m FROM log GROUP BY 1, 2) SELECT feature_set, round(avg(m), 6) AS mape, count(*) AS zones FROM z GROUP BY 1")
def evl2(spark, sf):
    return rounded(ev.mape(prediction_log(spark, sf), "zone", ["feature_set"]), "mape")


RANKED = M + ", r AS (SELECT *, (rank() OVER w + (count(*) OVER (PARTITION BY feature_set, zone, y) - 1) / 2.0) / count(*) OVER (PARTITION BY feature_set, zone) AS pr FROM log WINDOW w AS (PARTITION BY feature_set, zone ORDER BY y))"


@query("evl3_by_condition", f"WITH {RANKED}, c AS (SELECT *, 'high' AS condition FROM r WHERE pr >= 0.9 UNION ALL SELECT *, 'low' FROM r WHERE pr <= 0.1 UNION ALL SELECT *, 'ordinary' FROM r WHERE pr > 0.1 AND pr < 0.9) SELECT feature_set, condition, {ERR} FROM c GROUP BY 1, 2")
def evl3(spark, sf):
    r = ranked(prediction_log(spark, sf), "y", ["feature_set", "zone"], "pr", percent=True)
    c = {"high": F.col("pr") >= 0.9, "low": F.col("pr") <= 0.1, "ordinary": (F.col("pr") > 0.1) & (F.col("pr") < 0.9)}
    return rounded(ev.by_condition(r, c, ["feature_set"]), *ERRS)


HARD = P + ", dd AS (SELECT zone, CAST(ts AS DATE) AS day, avg(y) AS m, max(y) AS x, max(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS tr FROM p GROUP BY 1, 2), lim AS (SELECT zone, quantile_cont(m, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM dd WHERE tr = 1 GROUP BY 1), lab AS (SELECT dd.zone, dd.day, m <= lo AS cold, x >= hi AS hot FROM dd JOIN lim ON dd.zone = lim.zone)"


@query("evl4_hard_days", f"WITH {HARD} SELECT zone, day, cold, hot FROM lab")
def evl4(spark, sf):
    return ev.hard_days(split_panel(spark, sf), "y", ["zone"]).select("zone", "day", "cold", "hot").distinct()


#: Samples of a day: line items by ship date, in cents. Days need six; thresholds of a test year come from the years before it.
REGIMES = (
    "ld AS (SELECT CAST(l_shipdate AS DATE) AS day, avg(CAST(round(l_extendedprice * 100) AS BIGINT)) AS m, max(CAST(round(l_extendedprice * 100) AS BIGINT)) AS x FROM lineitem GROUP BY 1 HAVING count(l_extendedprice) >= 6)"
    ", sw AS (SELECT a.day, a.m, a.x, abs(a.m - b.m) AS swing FROM ld a LEFT JOIN ld b ON b.day = a.day - 1), ty AS (SELECT unnest([1999, 2000]) AS test_year)"
    ", lm AS (SELECT test_year, quantile_cont(m, 0.1) AS c, quantile_cont(x, 0.9) AS h, quantile_cont(swing, 0.9) AS r FROM sw JOIN ty ON year(day) < test_year GROUP BY 1)"
    ", rg AS (SELECT test_year, day, x, CASE WHEN m <= c THEN 'cold' WHEN x >= h THEN 'hot' WHEN swing >= r THEN 'ramp' ELSE 'normal' END AS regime FROM sw CROSS JOIN ty LEFT JOIN lm USING (test_year))"
)


def _regimes(spark, sf):
    samples = table(spark, sf, "lineitem").select(F.col("l_shipdate").alias("ts"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    return stored(ev.daily_regimes(samples, [], "cents", spark.createDataFrame([(1999,), (2000,)], "test_year int")))


@query("evl5_regimes", f"WITH {REGIMES} SELECT CAST(test_year AS INT) AS test_year, CAST(year(day) AS INT) AS year, regime, count(*) AS days FROM rg GROUP BY 1, 2, 3")
def evl5(spark, sf):
    return _regimes(spark, sf).groupBy("test_year", F.year("day").alias("year"), "regime").agg(F.count(F.lit(1)).alias("days"))


def _pairs(spark, sf):
    return ev.paired(prediction_log(spark, sf), ["zone", "ts"], ("climatology", "mean"))


@query("evl6_gain_shares", f"WITH {PAIR}, g AS (SELECT zone, count(*) AS hours, avg(e_a) AS mae_a, avg(e_b) AS mae_b, avg(e_a - e_b) AS dmae, sum(e_a - e_b) AS s FROM pr GROUP BY 1) SELECT zone, hours, round(hours / (SELECT sum(hours) FROM g), 6) AS share_of_hours, round(mae_a, 6) AS mae_a, round(mae_b, 6) AS mae_b, round(dmae, 6) AS dmae, round(s / (SELECT sum(s) FROM g), 5) AS share_of_gain FROM g")
def evl6(spark, sf):
    g = ev.gain_shares(_pairs(spark, sf), "zone")
    return rounded(rounded(g, "share_of_hours", "mae_a", "mae_b", "dmae"), "share_of_gain", digits=5)


@query("evl7_high_minus_low", f"WITH {PAIR}, dd AS (SELECT zone, CAST(ts AS DATE) AS day, avg(y) AS m FROM h GROUP BY 1, 2), q AS (SELECT zone, quantile_cont(m, 0.5) AS med FROM dd GROUP BY 1), s AS (SELECT pr.*, dd.m > q.med AS high FROM pr JOIN dd ON pr.zone = dd.zone AND CAST(pr.ts AS DATE) = dd.day JOIN q ON q.zone = dd.zone) SELECT zone, round(avg(CASE WHEN high THEN e_a - e_b END) - avg(CASE WHEN NOT high THEN e_a - e_b END), 6) AS high_minus_low, count(*) AS hours FROM s GROUP BY 1")
def evl7(spark, sf):
    dd = hourly(spark, sf).groupBy("zone", F.to_date("ts").alias("day")).agg(F.avg("y").alias("m"))
    q = dd.groupBy("zone").agg(F.percentile("m", F.lit(0.5)).alias("med"))
    s = _pairs(spark, sf).withColumn("day", F.to_date("ts")).join(dd, ["zone", "day"]).join(q, "zone").withColumn("high", F.col("m") > F.col("med"))
    return s.groupBy("zone").agg(F.round(F.avg(F.when(F.col("high"), F.col("d"))) - F.avg(F.when(~F.col("high"), F.col("d"))), 6).alias("high_minus_low"), F.count(F.lit(1)).alias("hours"))


def drawn(source: str, block: str, draws: int) -> str:
    """SQL of the table of draws over the blocks of ``source``: wt (draw, block, w)."""
    return f"nm AS (SELECT list(DISTINCT {block} ORDER BY {block}) AS names FROM {source}), dk AS (SELECT unnest(range({draws})) AS draw), pk AS (SELECT draw, unnest(range(len(names))) AS pick, names FROM nm, dk), wt AS (SELECT draw, names[1 + CAST(('0x' || md5('0|' || draw || '|' || pick)[:8]) AS BIGINT) % len(names)] AS block, count(*) AS w FROM pk GROUP BY 1, 2)"


def resampled_sql(block: str, draws: int) -> str:
    return f"WITH {PAIR}, x AS (SELECT zone, {block} AS block, e_a - e_b AS d FROM pr), {drawn('x', 'block', draws)}, b AS (SELECT zone, block, sum(d) AS s, count(*) AS n FROM x GROUP BY 1, 2), dr AS (SELECT zone, draw, sum(s * w) / sum(n * w) AS r FROM b JOIN wt USING (block) GROUP BY 1, 2), i AS (SELECT zone, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM dr GROUP BY 1), t AS (SELECT zone, sum(s) / sum(n) AS mean, count(*) AS blocks FROM b GROUP BY 1) SELECT zone, round(mean, 6) AS mean, round(lo, 6) AS lo, round(hi, 6) AS hi, blocks FROM t JOIN i USING (zone)"


@query("evl8_week_bootstrap", resampled_sql(WEEK, 2000))
def evl8(spark, sf):
    return rounded(ev.block_resampling(_pairs(spark, sf).withColumn("week", iso_week(F.col("ts"))), "week", "d", ["zone"]), "mean", "lo", "hi")


#: Two baselines over the years before 2000 and their errors in 2000, with the regime of each day.
YEAR = (
    f"{D}, {REGIMES}, ka AS (SELECT zone, month(ts) AS mo, avg(y) AS p FROM d WHERE year(ts) < 2000 GROUP BY 1, 2), kb AS (SELECT zone, avg(y) AS p FROM d WHERE year(ts) < 2000 GROUP BY 1)"
    f", yp AS (SELECT d.zone, d.ts, CAST(d.ts AS DATE) AS day, abs(ka.p - y) AS e_a, abs(kb.p - y) AS e_b, coalesce(regime, 'none') AS regime, {WEEK} AS block FROM d JOIN ka ON ka.zone = d.zone AND ka.mo = month(ts) JOIN kb ON kb.zone = d.zone LEFT JOIN rg ON rg.test_year = 2000 AND rg.day = CAST(d.ts AS DATE) WHERE year(ts) = 2000)"
)


def _year_pairs(spark, sf, regimes):
    """(zone, ts, day, e_a, e_b, d, regime, week) of the test year 2000."""
    d = daily(spark, sf).withColumn("mo", F.month("ts"))
    past = d.filter(F.year("ts") < 2000).groupBy("zone", "mo").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    months = F.map_from_entries(F.collect_list(F.struct("mo", F.col("s") / F.col("n"))))
    means = past.groupBy("zone").agg(months.alias("months"), (F.sum("s") / F.sum("n")).alias("all"))
    labels = regimes.filter("test_year = 2000").select("day", "regime")
    both = d.filter(F.year("ts") == 2000).join(means, "zone").withColumns({"day": F.to_date("ts"), "e_a": F.abs(F.try_element_at("months", F.col("mo")) - F.col("y")), "e_b": F.abs(F.col("all") - F.col("y"))})
    both = both.dropna(subset=["e_a", "e_b"]).join(labels, "day", "left")
    return stored(both.select("zone", "ts", "day", "e_a", "e_b", (F.col("e_a") - F.col("e_b")).alias("d"), F.coalesce("regime", F.lit("none")).alias("regime"), iso_week(F.col("ts")).alias("week")))


@query(
    "evl6_gain_by_regime",
    f"WITH {YEAR}, {drawn('yp', 'block', 2000)}, b AS (SELECT regime, block, sum(e_a - e_b) AS s, count(*) AS n FROM yp GROUP BY 1, 2), i AS (SELECT regime, quantile_cont(r, 0.025) AS lo, quantile_cont(r, 0.975) AS hi FROM (SELECT regime, draw, sum(s * w) / sum(n * w) AS r FROM b JOIN wt USING (block) GROUP BY 1, 2) GROUP BY 1)"
    ", g AS (SELECT regime, count(*) AS hours, avg(e_a) AS mae_a, avg(e_b) AS mae_b, avg(e_a - e_b) AS dmae, sum(e_a - e_b) AS s FROM yp GROUP BY 1) SELECT regime, hours, round(hours / (SELECT sum(hours) FROM g), 6) AS share_of_hours, round(mae_a, 3) AS mae_a, round(mae_b, 3) AS mae_b, round(dmae, 3) AS dmae, round(s / (SELECT sum(s) FROM g), 5) AS share_of_gain, round(lo, 3) AS lo, round(hi, 3) AS hi FROM g JOIN i USING (regime)",
)
def evl6_regimes(spark, sf):
    """Gain by regime with intervals; all regimes see the same resampled weeks."""
    pairs = _year_pairs(spark, sf, _regimes(spark, sf))
    g = ev.gain_shares(pairs, "regime", ev.resampling_weights(pairs, "week"))
    return rounded(rounded(rounded(g, "mae_a", "mae_b", "dmae", "lo", "hi", digits=3), "share_of_hours"), "share_of_gain", digits=5)


@query(
    "evl7_joint_resampling",
    f"WITH {YEAR}, kn AS (SELECT t.day, ld.x AS basis FROM (SELECT DISTINCT day, day - 2 AS at FROM (SELECT day FROM yp UNION SELECT day FROM rg)) t ASOF LEFT JOIN ld ON ld.day <= t.at), th AS (SELECT quantile_cont(basis, 0.5) AS med, quantile_cont(basis, 0.75) AS upq FROM rg JOIN kn USING (day) WHERE test_year = 2000 AND year(day) < 2000 AND regime = 'cold')"
    f", z AS (SELECT split, CASE WHEN regime = 'cold' THEN 'cold' ELSE 'other' END AS days, block, e_b - e_a AS g, CASE split WHEN 'median' THEN basis > med ELSE basis > upq END AS high FROM yp LEFT JOIN kn USING (day) CROSS JOIN th CROSS JOIN (SELECT unnest(['median', 'upper quartile']) AS split)), {drawn('z', 'block', 2000)}"
    ", b AS (SELECT split, days, block, sum(CASE WHEN high THEN g END) AS sh, count_if(high) AS nh, sum(CASE WHEN NOT high THEN g END) AS sl, count_if(NOT high) AS nl FROM z GROUP BY 1, 2, 3)"
    ", r AS (SELECT split, days, draw, sum(sh * w) / nullif(sum(nh * w), 0) AS h, sum(sl * w) / nullif(sum(nl * w), 0) AS l FROM b JOIN wt USING (block) GROUP BY 1, 2, 3)"
    ", i AS (SELECT split, days, quantile_cont(h - l, 0.025) AS lo, quantile_cont(h - l, 0.975) AS hi FROM r GROUP BY 1, 2), t AS (SELECT split, days, CAST(sum(nh) AS BIGINT) AS hours_high, CAST(sum(nl) AS BIGINT) AS hours_low, sum(sh) / nullif(sum(nh), 0) AS h, sum(sl) / nullif(sum(nl), 0) AS l FROM b GROUP BY 1, 2)"
    " SELECT split, days, hours_high, hours_low, round(h, 3) AS gain_high, round(l, 3) AS gain_low, round(h - l, 3) AS high_minus_low, round(lo, 3) AS high_minus_low_lo, round(hi, 3) AS high_minus_low_hi FROM t JOIN i USING (split, days)",
)
def evl7_joint(spark, sf):
    """Gain on days of high and of low basis, the last one known two days before; both sides are resampled jointly."""
    from ..operators.temporal import backward_asof

    regimes = _regimes(spark, sf)
    pairs, labels = _year_pairs(spark, sf, regimes), regimes.filter("test_year = 2000")
    known = labels.select(F.col("day").cast("timestamp_ntz").alias("ts"), F.col("max").alias("basis"), F.lit(1).alias("one"))
    days = pairs.select("day").union(labels.select("day")).distinct().select("day", F.date_sub("day", 2).cast("timestamp_ntz").alias("ts"), F.lit(1).alias("one"))
    basis = backward_asof(days, known, ["one"], ["basis"]).select("day", "basis")
    cold = labels.filter((F.year("day") < 2000) & (F.col("regime") == "cold")).join(basis, "day")
    ends = cold.agg(F.percentile("basis", F.array(F.lit(0.5), F.lit(0.75))).alias("q"))  # the cold days of a calendar
    limits = ends.select(F.explode(F.array(*[F.struct(F.lit(n).alias("split"), F.col("q")[k].alias("limit")) for k, n in enumerate(("median", "upper quartile"))])).alias("r")).select("r.*")
    split = pairs.join(basis, "day", "left").crossJoin(F.broadcast(limits))  # two rows
    split = split.withColumns({"high": F.col("basis") > F.col("limit"), "days": F.when(F.col("regime") == "cold", "cold").otherwise("other")})
    out = ev.gain_split(split, "high", ev.resampling_weights(pairs, "week"), "week", ["split", "days"])
    names = ["gain_high", "gain_low", "high_minus_low", "high_minus_low_lo", "high_minus_low_hi"]
    return rounded(out.select("split", "days", "hours_high", "hours_low", *names), *names, digits=3)


@query("evl8_block_sums", f"WITH {PAIR} SELECT zone, {WEEK} AS week, round(sum(e_a - e_b), 5) AS s, count(*) AS n FROM pr GROUP BY 1, 2")
def evl8_sums(spark, sf):
    return _pairs(spark, sf).groupBy("zone", iso_week(F.col("ts")).alias("week")).agg(F.round(F.sum("d"), 5).alias("s"), F.count("d").alias("n"))


@query("evl9_day_bootstrap", resampled_sql("CAST(CAST(ts AS DATE) AS VARCHAR)", 1000))
def evl9(spark, sf):
    return rounded(ev.block_resampling(_pairs(spark, sf).withColumn("day", F.to_date("ts").cast("string")), "day", "d", ["zone"], draws=1000), "mean", "lo", "hi")


@query("evl10_summary", f"WITH {M}, b AS (SELECT zone, avg(abs(yhat - y)) AS ref FROM log WHERE feature_set = 'mean' GROUP BY 1) SELECT log.zone, feature_set, round(avg(abs(yhat - y)), 6) AS mae, round(avg(abs(yhat - y)) - max(ref), 6) AS dmae_vs_ref FROM log JOIN b ON log.zone = b.zone GROUP BY 1, 2")
def evl10(spark, sf):
    g = prediction_log(spark, sf).groupBy("zone", "feature_set").agg(F.avg(F.abs(F.col("yhat") - F.col("y"))).alias("mae"))
    ref = g.filter("feature_set = 'mean'").select("zone", F.col("mae").alias("ref"))
    return rounded(g.join(ref, "zone").select("zone", "feature_set", "mae", (F.col("mae") - F.col("ref")).alias("dmae_vs_ref")), "mae", "dmae_vs_ref")


@query("evl11_contrasts", f"WITH {PAIR} SELECT zone, round(avg(e_a), 6) AS mae_first, round(avg(e_b), 6) AS mae_second, round(avg(e_a - e_b), 6) AS dmae, count(*) AS n FROM pr GROUP BY 1")
def evl11(spark, sf):
    return _pairs(spark, sf).groupBy("zone").agg(F.round(F.avg("e_a"), 6).alias("mae_first"), F.round(F.avg("e_b"), 6).alias("mae_second"), F.round(F.avg("d"), 6).alias("dmae"), F.count(F.lit(1)).alias("n"))


INTERVAL = f"WITH {PAIR}, b AS (SELECT zone, {WEEK} AS week, sum(e_a - e_b) AS s, count(*) AS n, sum(e_b) AS sb FROM pr GROUP BY 1, 2), t AS (SELECT zone, sum(s) AS ts, CAST(sum(n) AS DOUBLE) AS tn, count(*) AS k, sum(sb) / sum(n) AS base FROM b GROUP BY 1), v AS (SELECT b.zone, sqrt(sum(power(s - ts / tn * n, 2)) * max(k) / nullif(max(k) - 1, 0)) / max(tn) AS se, max(ts / tn) AS d, max(base) AS base, max(k) AS k FROM b JOIN t ON b.zone = t.zone GROUP BY 1)"


@query("evl12_relative_gain", f"{INTERVAL} SELECT zone, round(-100 * d / base, 5) AS gain, round(-100 * (d + 1.959964 * se) / base, 5) AS lo, round(-100 * (d - 1.959964 * se) / base, 5) AS hi FROM v")
def evl12(spark, sf):
    pairs = _pairs(spark, sf).withColumn("week", iso_week(F.col("ts")))
    base = pairs.groupBy("zone").agg(F.avg("e_b").alias("base"))
    g = ev.block_interval(pairs, "week", "d", ["zone"]).join(base, "zone")
    gain, lo, hi = ev.relative_gain(F.col("base"), F.col("mean"), F.col("lo"), F.col("hi"))
    return rounded(g.select("zone", gain.alias("gain"), lo.alias("lo"), hi.alias("hi")), "gain", "lo", "hi", digits=5)


@query("evl8_block_interval", f"{INTERVAL} SELECT zone, round(d, 6) AS mean, round(d - 1.959964 * se, 5) AS lo, round(d + 1.959964 * se, 5) AS hi, k AS blocks FROM v")
def evl8_interval(spark, sf):
    g = ev.block_interval(_pairs(spark, sf).withColumn("week", iso_week(F.col("ts"))), "week", "d", ["zone"])
    return rounded(rounded(g, "mean"), "lo", "hi", digits=5)


@query("evl13_leads_common_hours", "WITH " + H + ", x AS (SELECT unnest([24, 48, 72]) AS lead), l AS (SELECT a.zone, a.ts, x.lead, abs(b.y - a.y) AS e FROM h a CROSS JOIN x JOIN h b ON a.zone = b.zone AND b.ts = a.ts - to_hours(x.lead)), c AS (SELECT zone, ts FROM l GROUP BY 1, 2 HAVING count(DISTINCT lead) = 3) SELECT lead, count(*) AS n, round(avg(e), 6) AS mae FROM l SEMI JOIN c ON l.zone = c.zone AND l.ts = c.ts GROUP BY 1")
def evl13(spark, sf):
    from ..operators.temporal import at_all, exact_lag

    h = exact_lag(hourly(spark, sf), ["zone"], "y", {"24": 86400, "48": 172800, "72": 259200})
    long = h.unpivot(["zone", "ts", "y"], ["24", "48", "72"], "lead", "p").dropna(subset=["p"]).withColumn("lead", F.col("lead").cast("int"))
    common = at_all(long, ["zone", "ts"], "lead", [24, 48, 72])
    return common.groupBy("lead").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("p") - F.col("y"))), 6).alias("mae"))


@query(
    "evl14_sample_efficiency",
    f"WITH {D}, mm AS (SELECT DISTINCT year(ts) * 12 + month(ts) AS m FROM d WHERE year(ts) < 2000), k AS (SELECT draw, m FROM (SELECT draw, m, row_number() OVER (PARTITION BY draw ORDER BY md5(draw || '|' || CAST(m AS VARCHAR))) AS n FROM mm, (SELECT unnest(range(3)) AS draw)) WHERE n <= 6)"
    ", f AS (SELECT draw, zone, avg(y) AS yhat FROM d JOIN k ON year(ts) * 12 + month(ts) = m AND year(ts) < 2000 GROUP BY 1, 2), a AS (SELECT zone, avg(y) AS yhat FROM d WHERE year(ts) < 2000 GROUP BY 1)"
    ", e AS (SELECT d.zone, d.ts, draw, abs(f.yhat - y) AS e, abs(a.yhat - y) AS ea FROM d JOIN f ON f.zone = d.zone JOIN a ON a.zone = d.zone WHERE year(ts) = 2000)"
    ", h AS (SELECT zone, ts, avg(e) AS e, max(ea) AS ea FROM e GROUP BY 1, 2), r AS (SELECT zone, min(mae) AS lo, max(mae) AS hi, CAST(count_if(mae < ref) AS BIGINT) AS wins, count(*) AS n FROM (SELECT zone, draw, avg(e) AS mae, avg(ea) AS ref FROM e GROUP BY 1, 2) GROUP BY 1)"
    " SELECT h.zone, round(avg(e), 3) AS mae, round(max(lo), 3) AS mae_draw_min, round(max(hi), 3) AS mae_draw_max, max(n) AS n_draws, max(wins) AS wins, round(avg(h.ea), 3) AS mae_all FROM h JOIN r ON r.zone = h.zone GROUP BY 1",
)
def evl14(spark, sf):
    """Six random months of training, three draws: errors of each hour are averaged over draws first; wins against all months."""
    d = daily(spark, sf)
    past, test = d.filter(F.year("ts") < 2000), d.filter(F.year("ts") == 2000)
    draws = [sp.random_months(past, 6, k).groupBy("zone").agg(F.avg("y").alias("yhat")).withColumn("draw", F.lit(k)) for k in range(3)]
    fits = draws[0].unionByName(draws[1]).unionByName(draws[2])
    everything = past.groupBy("zone").agg(F.avg("y").alias("all"))
    errors = test.join(everything, "zone").join(fits, "zone").select("zone", "ts", "draw", F.abs(F.col("yhat") - F.col("y")).alias("e"), F.abs(F.col("all") - F.col("y")).alias("ref"))
    return rounded(ev.over_draws(errors, ["zone"], ["ts"], "draw", "e", "ref"), "mae", "mae_draw_min", "mae_draw_max", "mae_all", digits=3)


@query("evl15_forecast_skill", f"WITH {H}, f AS (SELECT a.zone, a.ts, a.y, b.y AS f1, c.y AS f2 FROM h a JOIN h b ON a.zone = b.zone AND b.ts = a.ts - INTERVAL 24 HOUR JOIN h c ON a.zone = c.zone AND c.ts = a.ts - INTERVAL 48 HOUR) SELECT zone, count(*) AS n, round(sqrt(avg(power(f1 - y, 2))), 6) AS rmse, round(1 - sum(power(f1 - y, 2)) / sum(power(f2 - y, 2)), 6) AS skill FROM f GROUP BY 1")
def evl15(spark, sf):
    from ..operators.temporal import exact_lag

    f = exact_lag(hourly(spark, sf), ["zone"], "y", {"f1": 86400, "f2": 172800}).dropna()
    e1, e2 = (F.col("f1") - F.col("y")) ** 2, (F.col("f2") - F.col("y")) ** 2
    return rounded(f.groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e1)).alias("rmse"), ev.skill(e1, e2).alias("skill")), "rmse", "skill")


@query("evl16_sign_hits", f"WITH {M}, s AS (SELECT feature_set, y - 50 AS a, yhat - 50 AS p FROM log) SELECT feature_set, count(*) AS n, round(avg(CASE WHEN sign(a) = sign(p) THEN 1.0 ELSE 0.0 END), 6) AS hit_rate, round(1 - sum(abs(p - a)) / sum(abs(a)), 6) AS skill_vs_zero FROM s WHERE abs(a) > 5 GROUP BY 1")
def evl16(spark, sf):
    s = prediction_log(spark, sf).select("feature_set", (F.col("y") - 50).alias("a"), (F.col("yhat") - 50).alias("p")).filter("abs(a) > 5")
    return rounded(s.groupBy("feature_set").agg(F.count(F.lit(1)).alias("n"), F.avg((F.signum("a") == F.signum("p")).cast("double")).alias("hit_rate"), ev.skill(F.abs(F.col("p") - F.col("a")), F.abs("a")).alias("skill_vs_zero")), "hit_rate", "skill_vs_zero")


@query("evl17_ramps", f"WITH {H}, r AS (SELECT a.zone, a.ts, abs(a.y - b.y) AS ramp FROM h a JOIN h b ON a.zone = b.zone AND b.ts = a.ts - INTERVAL 3 HOUR), q AS (SELECT zone, quantile_cont(ramp, 0.95) AS t FROM r GROUP BY 1) SELECT r.zone, ts, round(ramp, 6) AS ramp FROM r JOIN q ON r.zone = q.zone WHERE ramp >= t")
def evl17(spark, sf):
    from ..operators.temporal import exact_lag

    r = exact_lag(hourly(spark, sf), ["zone"], "y", {"past": 10800}).dropna().select("zone", "ts", F.abs(F.col("y") - F.col("past")).alias("ramp"))
    q = r.groupBy("zone").agg(F.percentile("ramp", F.lit(0.95)).alias("t"))
    return rounded(r.join(q, "zone").filter("ramp >= t").select("zone", "ts", "ramp"), "ramp")


@query("evl18_by_hour", f"WITH {M} SELECT feature_set, CAST(hour(ts) AS INT) AS hr, round(avg(abs(yhat - y)), 6) AS mae, count(*) AS n FROM log GROUP BY 1, 2")
def evl18(spark, sf):
    return prediction_log(spark, sf).groupBy("feature_set", F.hour("ts").alias("hr")).agg(F.round(F.avg(F.abs(F.col("yhat") - F.col("y"))), 6).alias("mae"), F.count(F.lit(1)).alias("n"))


@query("evl19_by_distance", f"WITH {M}, t AS (SELECT DISTINCT zone, CAST(ts AS DATE) AS day FROM p WHERE split = 'train'), u AS (SELECT DISTINCT zone, CAST(ts AS DATE) AS day FROM log), n AS (SELECT u.zone, u.day, min(abs(date_diff('day', u.day, t.day))) AS distance FROM u JOIN t ON u.zone = t.zone GROUP BY 1, 2) SELECT feature_set, CAST(distance AS INT) AS distance, round(avg(abs(yhat - y)), 6) AS mae, count(*) AS n FROM log JOIN n ON log.zone = n.zone AND CAST(log.ts AS DATE) = n.day GROUP BY 1, 2")
def evl19(spark, sf):
    from ..operators.temporal import days_to_nearest

    days = split_panel(spark, sf).groupBy("zone", F.to_date("ts").alias("day")).agg(F.bool_or(F.col("split") == "train").alias("train"))
    near = days_to_nearest(days, ["zone"], "train").select("zone", "day", "distance")
    log = prediction_log(spark, sf).withColumn("day", F.to_date("ts")).join(near, ["zone", "day"])
    return log.groupBy("feature_set", "distance").agg(F.round(F.avg(F.abs(F.col("yhat") - F.col("y"))), 6).alias("mae"), F.count(F.lit(1)).alias("n"))


@query("evl20_decile_means", f"WITH {M}, x AS (SELECT y, abs(yhat - y) AS e FROM log WHERE feature_set = 'mean'), q AS (SELECT unnest(quantile_cont(y, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM x), d AS (SELECT (SELECT count(*) FROM q WHERE x.y > q.edge) AS bin, e FROM x), g AS (SELECT bin, count(*) AS n, avg(e) AS m FROM d GROUP BY 1) SELECT CAST(bin AS INT) AS bin, n, round(m, 6) AS mean, round((SELECT sum(n * power(m - (SELECT avg(e) FROM d), 2)) FROM g) / (SELECT var_pop(e) * count(*) FROM d), 6) AS explained FROM g")
def evl20_deciles(spark, sf):
    x = prediction_log(spark, sf).filter("feature_set = 'mean'").select("y", F.abs(F.col("yhat") - F.col("y")).alias("e"))
    bins = quantile_bins(x, "y", 10).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("mean"), F.sum("e").alias("_s"), F.sum(F.col("e") * F.col("e")).alias("_q"))
    total = bins.agg(F.sum("n").alias("_n"), F.sum("_s").alias("_t"), F.sum("_q").alias("_tq"), F.sum(F.col("_s") ** 2 / F.col("n")).alias("_b"))
    share = (F.col("_b") - F.col("_t") ** 2 / F.col("_n")) / (F.col("_tq") - F.col("_t") ** 2 / F.col("_n"))
    return rounded(bins.crossJoin(F.broadcast(total)).select("bin", "n", "mean", share.alias("explained")), "mean", "explained")  # one row


@query("evl20_profile", f"WITH {M}, x AS (SELECT zone, y, abs(yhat - y) AS e, rank() OVER (PARTITION BY zone ORDER BY y) + (count(*) OVER (PARTITION BY zone, y) - 1) / 2.0 AS ry, rank() OVER (PARTITION BY zone ORDER BY abs(yhat - y)) + (count(*) OVER (PARTITION BY zone, abs(yhat - y)) - 1) / 2.0 AS re FROM log WHERE feature_set = 'mean') SELECT zone, round(corr(y, e), 6) AS pearson, round(corr(ry, re), 6) AS spearman FROM x GROUP BY 1")
def evl20(spark, sf):
    x = prediction_log(spark, sf).filter("feature_set = 'mean'").select("zone", "y", F.abs(F.col("yhat") - F.col("y")).alias("e"))
    x = ranked(ranked(x, "y", ["zone"], "ry"), "e", ["zone"], "re")
    return rounded(x.groupBy("zone").agg(F.corr("y", "e").alias("pearson"), F.corr("ry", "re").alias("spearman")), "pearson", "spearman")


@query("evl21_correlation_matrix", "SELECT CAST(i AS INT) AS i, label, round(corr(x, y), 5) AS r FROM (SELECT label, unnest(range(1, 5)) AS i, unnest(embedding[1:4]) AS x, embedding[5] AS y FROM embeddings) GROUP BY 1, 2")
def evl21(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.posexplode(F.slice("embedding", 1, 4)).alias("i", "x"), F.col("embedding")[4].alias("y"))
    return rounded(e.groupBy((F.col("i") + 1).alias("i"), "label").agg(F.corr(F.col("x").cast("double"), F.col("y").cast("double")).alias("r")), "r", digits=5)


@query("win7_quantile_bins", f"WITH {H}, e AS (SELECT unnest(quantile_cont(y, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])) AS edge FROM h) SELECT CAST((SELECT count(*) FROM e WHERE h.y > e.edge) AS INT) AS bin, count(*) AS n, round(avg(y), 6) AS y FROM h GROUP BY 1")
def win7(spark, sf):
    return quantile_bins(hourly(spark, sf), "y", 10).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("y"))


@query("tim13_month_ids", f"WITH {D} SELECT CAST(year(ts) * 12 + month(ts) AS INT) AS month_id, count(*) AS n FROM d GROUP BY 1")
def tim13(spark, sf):
    return daily(spark, sf).groupBy(month_id(F.col("ts")).alias("month_id")).agg(F.count(F.lit(1)).alias("n"))


@query("mod2_native_category")
def mod2(spark, sf):
    p = _features(spark, sf)
    model = mo.fit_trees(p.filter("split = 'train'"), ["lag24", "hour"], ["zone"], trees=3, depth=3)
    return model.transform(p.filter("split = 'test'")).transform(ev.errors_by, ["zone"])


@query("mod3_losses")
def mod3(spark, sf):
    """The same trees for absolute, Huber and quantile losses."""
    p = _features(spark, sf)
    test = p.filter("split = 'test'")
    parts = [_grown(p, trees=60, depth=4, rate=0.3, loss=n, level=level).predict(test).select("zone", "y", "yhat", F.lit(n).alias("loss")) for n, level in (("absolute", 0.5), ("huber", 5.0), ("quantile", 0.5))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).transform(ev.errors_by, ["loss", "zone"])


@query("mod5_staged_errors")
def mod5(spark, sf):
    """Mean squared error on test rows by number of trees."""
    p = _features(spark, sf)
    model, test = _grown(p, trees=100), p.filter("split = 'test'")
    out = test
    for k in STAGES:
        out = model.predict(out, f"p{k}", trees=k)
    errors = out.agg(*[F.avg((F.col(f"p{k}") - F.col("y")) ** 2).alias(f"p{k}") for k in STAGES])
    return errors.select(F.explode(F.array(*[F.struct(F.lit(k).alias("trees"), F.col(f"p{k}").alias("mse")) for k in STAGES])).alias("r")).select("r.*")


STAGES = (1, 5, 20, 100)


@query("mod10_importance")
def mod10(spark, sf):
    model = _grown(_features(spark, sf), trees=100)
    return spark.createDataFrame(list(model.importances().items()), "feature string, importance double")


@query("mod10_shap")
def mod10_shap(spark, sf):
    """Mean size of each feature's attribution on test rows, and how far attributions are from adding up."""
    p = _features(spark, sf)
    model = _grown(p, trees=100)
    rows = model.attribute(model.predict(p.filter("split = 'test'")))
    total = F.aggregate("shap", F.lit(0.0), lambda s, x: s + x)
    off = F.abs(F.col("yhat") - model.expected - total).alias("off")
    names = F.array(*map(F.lit, FEATURES))
    each = rows.select(off, F.explode(F.arrays_zip(names.alias("feature"), F.col("shap").alias("value"))).alias("r")).select("off", "r.*")
    return each.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_size"), F.avg("value").alias("mean"), F.max("off").alias("off"), F.count(F.lit(1)).alias("n"))
