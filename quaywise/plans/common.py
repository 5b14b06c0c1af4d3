"""Panels that the queries share, as DataFrames and as SQL with the same rows."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.stores import located
from ..sources.tables import table

#: Hourly mean of events by type: the panel (zone, ts, y).
H = "h AS (SELECT event_type AS zone, date_trunc('hour', ts) AS ts, avg(value) AS y FROM events GROUP BY 1, 2)"
#: Daily order value by market segment over years: (zone, ts, y).
D = "d AS (SELECT c_mktsegment AS zone, o_orderdate AS ts, sum(o_totalprice) AS y FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"
#: The hourly panel split in blocks of the month.
P = H + ", p AS (SELECT *, CASE WHEN day(ts) <= 18 THEN 'train' WHEN day(ts) <= 21 THEN 'val' ELSE 'test' END AS split FROM h)"
#: Two baselines: hourly climatology (a) and zone mean (b), on test rows.
M = (
    P
    + ", ma AS (SELECT zone, hour(ts) AS hr, avg(y) AS yhat FROM p WHERE split = 'train' GROUP BY 1, 2)"
    + ", mb AS (SELECT zone, avg(y) AS yhat FROM p WHERE split = 'train' GROUP BY 1)"
    + ", log AS (SELECT p.zone, p.ts, p.y, 'climatology' AS feature_set, ma.yhat FROM p JOIN ma ON p.zone = ma.zone AND hour(p.ts) = ma.hr WHERE split = 'test'"
    + " UNION ALL SELECT p.zone, p.ts, p.y, 'mean', mb.yhat FROM p JOIN mb ON p.zone = mb.zone WHERE split = 'test')"
)
PAIR = M + ", pr AS (SELECT a.zone, a.ts, abs(a.yhat - a.y) AS e_a, abs(b.yhat - b.y) AS e_b FROM log a JOIN log b ON a.zone = b.zone AND a.ts = b.ts AND a.feature_set = 'climatology' AND b.feature_set = 'mean')"


def _shared(spark: SparkSession) -> str:
    """The session's shared folder; a local session without one gets a temporary folder, which goes when the program ends."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        place = tempfile.mkdtemp(prefix="quaywise-")
        atexit.register(shutil.rmtree, place, ignore_errors=True)
        found = f"file://{place}"
        context.setCheckpointDir(found)
    return found.rstrip("/")


def folder(spark: SparkSession) -> str:
    """A new folder in the shared place for a query's own files; it goes when the program ends."""
    path = f"{_shared(spark)}/query-{uuid.uuid4().hex[:12]}"
    atexit.register(_remove, path)
    return path


def _remove(path: str) -> None:
    with contextlib.suppress(Exception):  # nobody is left to tell
        store, place = located(path)
        store.delete_dir(place)


def stored(df: DataFrame) -> DataFrame:
    """The rows, computed once: a checkpoint in the session's shared folder."""
    context, place = df.sparkSession.sparkContext, _shared(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(place)
    return df.checkpoint()


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("zone"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.avg("value").alias("y"))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy(F.col("c_mktsegment").alias("zone"), F.col("o_orderdate").alias("ts")).agg(F.sum("o_totalprice").alias("y"))


def split_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.splits import blocked

    return hourly(spark, sf_dir).withColumn("split", blocked())


def prediction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows of two baselines: (zone, ts, y, feature_set, yhat).

    Both training means come from one aggregate: sums by zone and hour, then a row a zone that
    holds the mean of all hours and a map of the 24 hourly ones.
    """
    p = split_panel(spark, sf_dir).withColumn("hr", F.hour("ts"))
    sums = p.filter("split = 'train'").groupBy("zone", "hr").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    hours = F.map_from_entries(F.collect_list(F.struct("hr", F.try_divide("s", "n"))))
    means = sums.groupBy("zone").agg(hours.alias("hours"), F.try_divide(F.sum("s"), F.sum("n")).alias("mean"))
    test = p.filter("split = 'test'").join(means, "zone", "left")
    arms = F.array(*[F.struct(F.lit(n).alias("feature_set"), x.alias("yhat")) for n, x in (("climatology", F.try_element_at("hours", F.col("hr"))), ("mean", F.col("mean")))])
    return test.select("zone", "ts", "y", F.explode(arms).alias("arm")).select("zone", "ts", "y", "arm.*")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison between engines; counts as long."""
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])
