"""Shared working folder: tables that cut lineage and outlive a lost executor.

Spark's own ``spark.checkpoint.dir`` names a folder which the driver and all
executors share. Operators write intermediate tables there and read them back.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: The folder of each local application that names none.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a local temporary one only when unset and local."""
    app = spark.sparkContext.applicationId
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or _LOCAL.get(app)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        # the setting can't be changed in a running session, so the folder is remembered here
        found = _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="quaywise-")
        atexit.register(_remove_local, found.removeprefix("file://"))
    return found.rstrip("/")


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


#: Spark then removes a query's shuffle files when the query ends, not when the driver collects garbage.
#: Bucketed tables of one file a bucket are read as sorted as they are.
RUNNING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """SQL settings for a while."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Workspace:
    """A folder of one operator run inside the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        self._live: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it back: no lineage, safe when executors go."""
        path = self.path(name)
        schema = df.schema
        with settings(self.spark, RUNNING):
            df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        self._live[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables which nothing reads any more."""
        for path in [p for p, t in self._live.items() if any(t is x for x in tables)]:
            del self._live[path]
            self.delete(path)

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables but these."""
        self.drop(*(t for t in self._live.values() if not any(t is x for x in tables)))

    def delete(self, path: str) -> None:
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the store it is in, for readers outside Spark."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of text that a sample for a fit may have, the first text excepted.
SAMPLE_BYTES = 64 << 20


def hashed_sample(df: DataFrame, n: int, columns: list[str], most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """At most ``n`` distinct rows (doc_id, text, ``columns``) and ``most_bytes`` of text, those of least hash of (doc_id, text).

    Rows are drawn by what they are, not by doc_id: one id with many texts is as many rows, and
    copies of a row are one. A bound on the hash is set from their number first, so that tasks
    send about ``n`` of them altogether, however many tasks there are; texts are fetched last.
    """
    span = 1 << 40
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("_bytes")
    known = df.select("doc_id", F.xxhash64("text").alias("_text"), size, *columns).distinct()
    place = F.pmod(F.xxhash64("doc_id", "_text"), F.lit(span))
    total = known.count()
    if total > n:
        # six standard deviations above the expected number, so that n rows are found
        known = known.filter(place < int(span * min(1.0, (n + 6 * n**0.5 + 6) / total)))
    keys = ["doc_id", "_text", *columns]
    rows = known.orderBy(place, *keys).limit(n).select(*keys, "_bytes").collect()  # n rows of numbers and labels
    held, room = [], most_bytes
    for r in rows:
        room -= r["_bytes"]
        if room < 0 and held:
            break
        held.append(tuple(r[k] for k in keys))
    chosen = df.sparkSession.createDataFrame(held, known.select(*keys).schema)
    whole = df.select("doc_id", "text", F.xxhash64("text").alias("_text"), *columns).join(F.broadcast(chosen), keys, "left_semi")
    return whole.dropDuplicates(keys).drop("_text")
