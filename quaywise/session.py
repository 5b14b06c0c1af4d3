"""Session settings for local work; a cluster brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", partitions: int = 8, memory: str = "4g") -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cpus}]").config(
        map={
            "spark.driver.memory": memory,
            "spark.sql.shuffle.partitions": str(partitions),
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.adaptive.enabled": "true",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        }
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
