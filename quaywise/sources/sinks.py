"""Sinks: partitioned and idempotent writing, progress, several boxes in one scan, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Parquet by partition; only the partitions in ``df`` are replaced, each by an atomic commit."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_progress(df: DataFrame, path: str, run: dict[str, str]) -> None:
    """Append one model's rows under its own partition, so a crash keeps all finished ones."""
    marked = df.withColumns({k: F.lit(v) for k, v in run.items()})
    write_partitioned(marked, path, list(run))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", "true").csv(path)


def write_boxes(cells: DataFrame, boxes: DataFrame, path: str) -> None:
    """One scan written as a partition for each named box."""
    from ..operators.spatial import cells_in_boxes

    write_partitioned(cells_in_boxes(cells, boxes), path, ["box"])


def write_with_sidecar(df: DataFrame, path: str, facts: dict) -> None:
    """Parquet at ``path``/data, then a JSON line of facts at ``path``/sidecar; a reader that finds the sidecar finds all data."""
    df.write.mode("overwrite").parquet(f"{path}/data")
    line = json.dumps(facts, sort_keys=True)
    df.sparkSession.createDataFrame([(line,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/sidecar")


def read_sidecar(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/sidecar").head()[0])


def report(df: DataFrame, rows: str, columns: str, value: str, values: list) -> DataFrame:
    """A pivot for reading: mean of ``value`` by ``rows`` and ``columns``."""
    return df.groupBy(rows).pivot(columns, values).agg(F.avg(value))
