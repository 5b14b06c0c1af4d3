"""Evaluation of predictions: errors, conditions, regimes, contrasts, bootstrap intervals."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .panel import exact_quantile


def errors(y: str = "y", yhat: str = "yhat") -> list[Column]:
    """n, mae, median_ae, rmse, r2, bias of a group whose errors a task can hold."""
    e = F.col(yhat) - F.col(y)
    return [*_sums(y, yhat), F.percentile(F.abs(e), F.lit(0.5)).alias("median_ae")]


def _sums(y: str, yhat: str) -> list[Column]:
    e = F.col(yhat) - F.col(y)
    return [
        F.count(e).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.sum(e * e) / F.nullif(F.count(e) * F.var_pop(F.when(e.isNotNull(), F.col(y))), F.lit(0.0))).alias("r2"),
        F.avg(e).alias("bias"),
    ]


def errors_by(df: DataFrame, by: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """The errors of groups of any size: the median comes from ranks inside ranges of values, not from all rows of a group at once."""
    sums = df.groupBy(*by).agg(*_sums(y, yhat))
    median = exact_quantile(df.withColumn("_ae", F.abs(F.col(yhat) - F.col(y))), "_ae", by, 0.5, "median_ae")
    same = reduce(and_, [F.col(f"s.{k}").eqNullSafe(F.col(f"m.{k}")) for k in by])
    return sums.alias("s").join(median.alias("m"), same, "left").select("s.*", "median_ae")


def mape(df: DataFrame, zone: str, by: list[str], y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Unweighted mean over zones of each zone's mean absolute percentage error."""
    zones = df.groupBy(*by, zone).agg((100 * F.avg(F.abs(F.try_divide(F.col(yhat) - F.col(y), F.col(y))))).alias("_m"))
    return zones.groupBy(*by).agg(F.avg("_m").alias("mape"), F.count(F.lit(1)).alias("zones"))


def hard_days(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds cold (daily mean at most the training days' 5 % quantile) and hot (daily maximum at least the 95 %)."""
    daily = df.withColumn("day", F.to_date("ts")).groupBy(*by, "day").agg(F.avg(value).alias("_mean"), F.max(value).alias("_max"), F.max(F.col("split") == "train").alias("_train"))
    train = daily.filter("_train")
    limits = train.groupBy(*by).agg(F.percentile("_mean", F.lit(0.05)).alias("_low"), F.percentile("_max", F.lit(0.95)).alias("_high"))
    labels = daily.join(limits, by, "left").select(*by, "day", F.coalesce(F.col("_mean") <= F.col("_low"), F.lit(False)).alias("cold"), F.coalesce(F.col("_max") >= F.col("_high"), F.lit(False)).alias("hot"))
    return df.withColumn("day", F.to_date("ts")).join(labels, [*by, "day"], "left")


def regime(cold: Column, hot: Column, ramp: Column) -> Column:
    """cold before hot before ramp before normal."""
    return F.when(cold, "cold").when(hot, "hot").when(ramp, "ramp").otherwise("normal")


def daily_regimes(samples: DataFrame, by: list[str], value: str, years: DataFrame, least: int = 6, tail: float = 0.1) -> DataFrame:
    """(by, test_year, day, mean, max, swing, regime): every day's regime as seen from each test year of ``years`` (test_year).

    A day needs ``least`` samples. Its swing is the absolute change of the mean from the day
    before, null if that isn't there. Thresholds are exact quantiles over the days of the years
    before the test year: cold means at most the lower tail, hot maxima and swings at least the
    upper one. A test year without earlier days has normal days only.
    """
    from .panel import daily_difference

    days = samples.groupBy(*by, F.to_date("ts").alias("day")).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.count(value).alias("_n")).filter(F.col("_n") >= least).drop("_n")
    days = daily_difference(days, by, "mean", "day", "swing").withColumn("swing", F.abs("swing"))
    seen = days.crossJoin(F.broadcast(years.select("test_year").distinct()))  # some test years
    past = seen.filter(F.year("day") < F.col("test_year"))
    keys = [*by, "test_year"]
    # a day's row a group: a calendar's, however many samples there are
    limits = past.groupBy(*keys).agg(*[F.percentile(c, F.lit(q)).alias(n) for n, c, q in (("_cold", "mean", tail), ("_hot", "max", 1 - tail), ("_ramp", "swing", 1 - tail))])
    label = regime(F.col("mean") <= F.col("_cold"), F.col("max") >= F.col("_hot"), F.col("swing") >= F.col("_ramp"))
    return seen.join(limits, keys, "left").select(*keys, "day", "mean", "max", "swing", label.alias("regime"))


def by_condition(df: DataFrame, conditions: dict[str, Column], by: list[str]) -> DataFrame:
    """Errors of each group under each condition; a row counts under every condition that it meets."""
    tags = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in conditions.items()]))
    return df.withColumn("condition", F.explode(tags)).transform(errors_by, [*by, "condition"])


def paired(log: DataFrame, key: list[str], arms: tuple[str, str], arm: str = "feature_set", y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Absolute errors of two arms side by side on the rows that both have: e_a, e_b, d = e_a - e_b."""
    e = F.abs(F.col(yhat) - F.col(y))
    both = log.filter(F.col(arm).isin(*arms)).groupBy(*key).agg(F.max(F.when(F.col(arm) == arms[0], e)).alias("e_a"), F.max(F.when(F.col(arm) == arms[1], e)).alias("e_b"))
    return both.dropna(subset=["e_a", "e_b"]).withColumn("d", F.col("e_a") - F.col("e_b"))


def resampling_weights(blocks: DataFrame, block: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """(draw, block, weight): how often each draw takes each block, as many picks as there are blocks.

    A pick is MD5 of "seed|draw|pick" modulo the number of blocks, in order of their names, so
    any engine makes the same table. It is made once for all groups and arms that share the
    blocks; its size is draws * blocks whatever the data's (blocks: a calendar's weeks or days).
    """
    names = blocks.select(F.col(block).cast("string").alias(block)).filter(F.col(block).isNotNull()).distinct()
    held = names.agg(F.sort_array(F.collect_set(block)).alias("_names"))  # one row: a calendar
    picks = names.sparkSession.range(draws).withColumnRenamed("id", "draw").crossJoin(F.broadcast(held)).filter(F.size("_names") > 0)
    each = picks.select("draw", "_names", F.explode(F.sequence(F.lit(0), F.size("_names") - 1)).alias("_pick"))
    code = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.col("draw"), F.col("_pick"))), 1, 8), 16, 10).cast("long")
    return each.select("draw", F.col("_names")[(code % F.size("_names")).cast("int")].alias(block)).groupBy("draw", block).agg(F.count(F.lit(1)).alias("weight"))


def resampled(df: DataFrame, weights: DataFrame, block: str, by: list[str], measures: dict[str, tuple[Column, Column]], contrasts: dict[str, tuple[str, str]] | None = None, level: float = 0.95) -> DataFrame:
    """For each group, measures with intervals over the draws: name, name_lo, name_hi; and ``blocks``.

    A measure is a ratio of two sums of columns; a contrast is the difference of two measures
    within each draw, so both sides and all groups see the same blocks at once. A draw without
    rows of a measure doesn't count for it. The rows are summed by block first; only these sums
    meet the weights.
    """
    contrasts = contrasts or {}
    sums = df.withColumn(block, F.col(block).cast("string")).groupBy(*by, block).agg(*[F.sum(x).alias(f"_{side}_{n}") for n, parts in measures.items() for side, x in zip("td", parts)])
    ratio = lambda n, w: F.try_divide(F.sum(F.col(f"_t_{n}") * w), F.sum(F.col(f"_d_{n}") * w))
    minus = lambda: {n: F.col(a) - F.col(b) for n, (a, b) in contrasts.items()}
    seen = sums.groupBy(*by).agg(*[ratio(n, F.lit(1)).alias(n) for n in measures], F.count(block).alias("blocks")).withColumns(minus())
    drawn = sums.join(weights, block).groupBy(*by, "draw").agg(*[ratio(n, F.col("weight")).alias(n) for n in measures]).withColumns(minus())
    names = [*measures, *contrasts]
    ends = [F.percentile(n, F.lit(p)).alias(f"{n}_{side}") for n in names for side, p in (("lo", (1 - level) / 2), ("hi", (1 + level) / 2))]
    bounds = drawn.groupBy(*by).agg(*ends)  # as many rows a group as there are draws
    same = reduce(and_, [F.col(f"s.{k}").eqNullSafe(F.col(f"b.{k}")) for k in by], F.lit(True))
    return seen.alias("s").join(bounds.alias("b"), same, "left").select(*[f"s.{k}" for k in by], *[c for n in names for c in (n, f"{n}_lo", f"{n}_hi")], "blocks")


def block_resampling(df: DataFrame, block: str, value: str, by: list[str], draws: int = 2000, seed: int = 0, level: float = 0.95) -> DataFrame:
    """Mean of ``value`` with an interval from resampled blocks (weeks, days), by group: mean, lo, hi, blocks."""
    x = F.col(value)
    out = resampled(df, resampling_weights(df, block, draws, seed), block, by, {"mean": (x, x.isNotNull().cast("double"))}, level=level)
    return out.select(*by, "mean", F.col("mean_lo").alias("lo"), F.col("mean_hi").alias("hi"), "blocks")


def block_interval(df: DataFrame, block: str, value: str, by: list[str], z: float = 1.959964) -> DataFrame:
    """Mean of ``value`` and its normal interval over blocks (weeks), by group.

    The mean is a ratio of block sums, whose variance is that of the blocks' residuals; one
    block has no interval.
    """
    sums = df.groupBy(*by, block).agg(F.sum(value).alias("_s"), F.count(value).alias("_n"))
    total = sums.groupBy(*by).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"), F.count(F.lit(1)).alias("blocks"))
    residual = (F.col("_s") - F.col("_ts") / F.col("_tn") * F.col("_n")) ** 2
    spread = sums.join(total, by).groupBy(*by, "_ts", "_tn", "blocks").agg(F.sum(residual).alias("_q"))
    mean = F.col("_ts") / F.col("_tn")
    error = F.sqrt(F.col("_q") * F.try_divide(F.col("blocks"), F.col("blocks") - 1)) / F.col("_tn")
    return spread.select(*by, mean.alias("mean"), (mean - z * error).alias("lo"), (mean + z * error).alias("hi"), "blocks")


def gain_shares(pairs: DataFrame, group: str, weights: DataFrame | None = None, block: str = "week") -> DataFrame:
    """Hours, share of hours, errors of both arms, difference and share of the total gain, by group.

    With resampling ``weights`` of ``block`` also the difference's interval (lo, hi), all groups
    seeing the same draws.
    """
    g = pairs.groupBy(group).agg(F.count(F.lit(1)).alias("hours"), F.avg("e_a").alias("mae_a"), F.avg("e_b").alias("mae_b"), F.avg("d").alias("dmae"), F.sum("d").alias("_sum"))
    total = g.agg(F.sum("hours").alias("_h"), F.sum("_sum").alias("_g"))
    out = g.crossJoin(F.broadcast(total)).select(group, "hours", (F.col("hours") / F.col("_h")).alias("share_of_hours"), "mae_a", "mae_b", "dmae", F.try_divide(F.col("_sum"), F.col("_g")).alias("share_of_gain"))  # one row
    if weights is None:
        return out
    ends = resampled(pairs, weights, block, [group], {"d": (F.col("d"), F.lit(1.0))}).select(group, F.col("d_lo").alias("lo"), F.col("d_hi").alias("hi"))
    return out.join(ends, group, "left")


def gain_split(pairs: DataFrame, high: str, weights: DataFrame, block: str, by: list[str]) -> DataFrame:
    """Gains (e_b - e_a) where ``high`` holds and where it doesn't, and their difference, each with its interval from joint draws.

    gain_high, gain_low, high_minus_low with _lo and _hi, hours of both sides; rows where
    ``high`` is null belong to neither.
    """
    up, down = F.col(high).cast("double"), (~F.col(high)).cast("double")
    gain = F.col("e_b") - F.col("e_a")
    out = resampled(pairs, weights, block, by, {"gain_high": (gain * up, up), "gain_low": (gain * down, down)}, {"high_minus_low": ("gain_high", "gain_low")})
    hours = pairs.groupBy(*by).agg(F.count_if(F.col(high)).alias("hours_high"), F.count_if(~F.col(high)).alias("hours_low"))
    return out.join(hours, by)


def over_draws(errors: DataFrame, by: list[str], hour: list[str], draw: str, error: str, reference: str) -> DataFrame:
    """Errors of models fitted on several draws of training data, by group.

    mae: of each hour's error averaged over the draws; mae_draw_min, mae_draw_max: of single
    draws; wins: draws with a lower error than the reference; mae_all: the reference's.
    """
    hours = errors.groupBy(*by, *hour).agg(F.avg(error).alias("_e"), F.max(reference).alias("_r"))
    means = hours.groupBy(*by).agg(F.avg("_e").alias("mae"), F.avg("_r").alias("mae_all"))
    draws = errors.groupBy(*by, draw).agg(F.avg(error).alias("_m"), F.avg(reference).alias("_r"))
    spread = draws.groupBy(*by).agg(F.min("_m").alias("mae_draw_min"), F.max("_m").alias("mae_draw_max"), F.count(F.lit(1)).alias("n_draws"), F.count_if(F.col("_m") < F.col("_r")).alias("wins"))
    return means.join(spread, by).select(*by, "mae", "mae_draw_min", "mae_draw_max", "n_draws", "wins", "mae_all")


def relative_gain(base: Column, d: Column, lo: Column, hi: Column) -> tuple[Column, Column, Column]:
    """Gain in per cent and its bounds, which change places."""
    return -100 * d / base, -100 * hi / base, -100 * lo / base


def skill(se_model: Column, se_reference: Column) -> Column:
    return 1 - F.sum(se_model) / F.sum(se_reference)
