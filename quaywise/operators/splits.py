"""Splits of a panel into training, validation and test rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from .temporal import near_days


def year_ahead(df: DataFrame, ts: str = "ts") -> DataFrame:
    """The last year is the test; fewer than two years stop the query."""
    last = df.agg(F.max(F.year(ts)).alias("_last"), F.countDistinct(F.year(ts)).alias("_years"))
    marked = df.crossJoin(F.broadcast(last))  # one row
    split = F.when(F.col("_years") < 2, F.raise_error(F.lit("two years at least are needed")).cast("string")).when(F.year(ts) == F.col("_last"), "test").otherwise("train")
    return marked.withColumn("split", split).drop("_last", "_years")


def chronological(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Of the last year: to August training, September validation, then test; other years are unused."""
    last = df.agg(F.max(F.year(ts)).alias("_last"))
    split = F.when(F.year(ts) != F.col("_last"), "unused").when(F.month(ts) <= 8, "train").when(F.month(ts) == 9, "val").otherwise("test")
    return df.crossJoin(F.broadcast(last)).withColumn("split", split).drop("_last")  # one row


def blocked(ts: str = "ts") -> Column:
    """Days to 18 training, 19 to 21 validation, then test, every month."""
    return F.when(F.day(ts) <= 18, "train").when(F.day(ts) <= 21, "val").otherwise("test")


def rolling_origin(ts: str, year: int) -> Column:
    return F.when(F.year(ts) < year, "train").when(F.year(ts) == year, "test").otherwise("unused")


def excluded(split: Column, ts: str, first: str, last: str) -> Column:
    """Training rows of a window of dates become unused; other rows stay."""
    return F.when((split == "train") & F.to_date(F.col(ts)).between(first, last), "unused").otherwise(split)


def month_folds(df: DataFrame, ts: str = "ts", folds: int = 5) -> DataFrame:
    """Interleaved folds: the month's place among the months that occur, modulo ``folds``."""
    month = F.year(ts) * 12 + F.month(ts)
    # months are few: the ranking runs on the distinct ones, not on the rows
    months = df.select(month.alias("_month")).distinct().withColumn("fold", ((F.dense_rank().over(Window.orderBy("_month")) - 1) % folds).cast("int"))
    return df.withColumn("_month", month).join(F.broadcast(months), "_month").drop("_month")


def buffered_train(df: DataFrame, fold: int, days: int, ts: str = "ts", folds: int = 5) -> DataFrame:
    """Training rows of one fold: neither its own nor the validation fold's, nor within ``days`` of its days."""
    held = df.filter(F.col("fold") == fold).select(F.to_date(ts).alias("day")).distinct()
    rest = df.filter(~F.col("fold").isin(fold, (fold + 1) % folds)).withColumn("day", F.to_date(ts))
    return rest.join(near_days(held, days), "day", "left_anti")


def recent_months(df: DataFrame, n: int, ts: str = "ts") -> DataFrame:
    """Rows of the ``n`` latest months that occur."""
    month = F.year(ts) * 12 + F.month(ts)
    latest = df.select(month.alias("_month")).distinct().orderBy(F.desc("_month")).limit(n)
    return df.withColumn("_month", month).join(F.broadcast(latest), "_month", "left_semi").drop("_month")


def random_months(df: DataFrame, n: int, seed: int, ts: str = "ts") -> DataFrame:
    """Rows of ``n`` months drawn by md5(seed|month), the same in every engine."""
    month = F.year(ts) * 12 + F.month(ts)
    drawn = df.select(month.alias("_month")).distinct().orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("_month").cast("string")))).limit(n)
    return df.withColumn("_month", month).join(F.broadcast(drawn), "_month", "left_semi").drop("_month")


def training_times(df: DataFrame, axis: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows of an axis which training rows use."""
    return axis.join(df.filter(F.col("split") == "train").select(ts).distinct(), ts, "left_semi")
