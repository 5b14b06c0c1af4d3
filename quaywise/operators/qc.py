"""Quality control and resumable writing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def step_counts(df: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    """How often each time step (seconds) follows another."""
    w = Window.partitionBy(*by).orderBy(ts)
    step = F.timestamp_diff("SECOND", F.lag(ts).over(w), F.col(ts))
    return df.select(*by, step.alias("step_s")).dropna(subset=["step_s"]).groupBy("step_s").agg(F.count(F.lit(1)).alias("n"))


def coverage(df: DataFrame, by: list[str], ts: str = "ts") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.min(ts).alias("first"), F.max(ts).alias("last"), F.countDistinct(F.to_date(ts)).alias("days"))


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def conflicting(df: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """Keys quoted with values further apart than ``tolerance``."""
    return df.groupBy(*key).agg((F.max(value) - F.min(value)).alias("spread")).filter(F.col("spread") > tolerance)


def null_share(df: DataFrame, columns: list[str]) -> DataFrame:
    one = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    return one.unpivot([], columns, "column_name", "null_share")


def missing(expected: DataFrame, found: DataFrame, key: list[str]) -> DataFrame:
    """Expected keys that aren't there; also what is left to do after an interrupted run."""
    return expected.join(found.select(*key).distinct(), key, "left_anti")


def reconcile(parts: DataFrame, whole: DataFrame, key: list[str], value: str, tolerance: float) -> DataFrame:
    """Keys where the parts don't sum to the whole."""
    sums = parts.groupBy(*key).agg(F.sum(value).alias("parts"))
    return sums.join(whole.select(*key, F.col(value).alias("whole")), key).filter(F.abs(F.col("parts") - F.col("whole")) > tolerance)


def require_complete(expected: DataFrame, found: DataFrame, key: list[str]) -> None:
    """Stop with the first few expected keys that aren't there."""
    gaps = missing(expected, found, key).orderBy(*key).limit(5).collect()
    if gaps:
        raise ValueError(f"missing keys, the first of them: {[tuple(r) for r in gaps]}")


def drop_empty(df: DataFrame, blocks: dict[str, list[str]]) -> tuple[DataFrame, list[str]]:
    """Without the blocks of columns that are null throughout, and the names of those blocks."""
    columns = [c for names in blocks.values() for c in names]
    there = df.agg(*[F.count(c).alias(c) for c in columns]).head()
    empty = [n for n, names in blocks.items() if not any(there[c] for c in names)]
    return df.drop(*(c for n in empty for c in blocks[n])), empty


def write_missing(df: DataFrame, path: str, key: list[str]) -> int:
    """Append the partitions of ``df`` that ``path`` doesn't hold yet; returns how many key values were new."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path).select(*key).distinct()
        todo = df.join(done, key, "left_anti")
    except Exception as e:  # nothing is written yet
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        todo = df
    n = todo.select(*key).distinct().count()
    if n:
        todo.write.mode("append").partitionBy(*key).parquet(path)
    return n


def reconcile_order(a: DataFrame, b: DataFrame, by: list[str], key: str) -> DataFrame:
    """(by, rows_a, rows_b, same_place, first_off): whether two runs have the same keys in the same places.

    A row's place is that of its key in order, from 1; first_off is the first place where the
    keys differ or one run has no row, null if there is none. Keys of a group are distinct; its
    rows are numbered by ranges, so a group may be large.
    """
    from .panel import numbered_by

    left = numbered_by(a, by, key, "_n").select(*by, F.col(key).alias("_a"), "_n")
    right = numbered_by(b, by, key, "_n").select(*by, F.col(key).alias("_b"), "_n")
    both = left.join(right, [*by, "_n"], "full")
    off = F.when(~F.col("_a").eqNullSafe(F.col("_b")), F.col("_n"))
    return both.groupBy(*by).agg(F.count("_a").alias("rows_a"), F.count("_b").alias("rows_b"), F.count_if(F.col("_a") == F.col("_b")).alias("same_place"), F.min(off).alias("first_off"))
