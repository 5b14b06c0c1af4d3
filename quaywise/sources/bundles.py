"""Bundles of arrays (npz): a sink that publishes all files at once, and its scan."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader
from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type
from pyspark.sql.types import ArrayType, StructField, StructType

from .stores import StagedWriter, Stretch, files_of, located


def _arrays(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    """Columns as arrays: numbers and texts by row, lists of one length as matrices."""
    out = {}
    for name, column in zip(batch.schema.names, batch.columns):
        if column.null_count:
            raise ValueError(f"{name} has nulls, which a bundle can't hold")
        if pa.types.is_list(column.type):
            size = np.diff(column.offsets.to_numpy())
            if len(size) and size.min() != size.max():
                raise ValueError(f"{name} has lists of different lengths")
            out[name] = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), int(size[0]) if len(size) else 0)
        else:
            x = column.to_numpy(zero_copy_only=False)
            out[name] = x.astype(str) if x.dtype == object else x
    return out


class _Writer(StagedWriter):
    def __init__(self, path: str, overwrite: bool, rows: int):
        super().__init__(path, overwrite)
        self.rows = rows

    def put(self, batches: Iterator[pa.RecordBatch], begin) -> Iterator[str]:  # noqa: ANN001
        task, n, held, count = TaskContext.get().partitionId(), 0, [], 0

        def bundle() -> str:
            table = pa.Table.from_batches(held).combine_chunks()
            name = f"bundle-{task:05d}-{n:04d}.npz"
            file = io.BytesIO()
            np.savez_compressed(file, **_arrays(table.to_batches()[0]))
            with begin(name) as out:
                out.write(file.getvalue())
            held.clear()
            return name

        for batch in batches:
            at = 0
            while at < len(batch):
                part = batch.slice(at, self.rows - count)
                held.append(part)
                at, count = at + len(part), count + len(part)
                if count == self.rows:
                    yield bundle()
                    n, count = n + 1, 0
        if held:
            yield bundle()


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType):
        self.path, self.fields = path, schema

    def partitions(self) -> list[Stretch]:
        return [Stretch(place, size, 0, 1) for place, size in files_of(self.path, ".npz")]

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        store, _ = located(self.path)
        with store.open_input_file(part.place) as f, zipfile.ZipFile(f) as z:
            # only the members that are asked for are opened
            found = [np.lib.format.read_array(io.BytesIO(z.read(f"{k.name}.npy")), allow_pickle=False) for k in self.fields]
        n = len(found[0]) if found else 0
        for lo in range(0, n, 10_000):
            columns = []
            for x, k in zip(found, self.fields):
                x, kind = x[lo : lo + 10_000], to_arrow_type(k.dataType)
                if isinstance(k.dataType, ArrayType):
                    wide = x.shape[1] if x.ndim > 1 else 0
                    columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * wide), pa.array(x.ravel(), kind.value_type)))
                else:
                    columns.append(pa.array(x, kind))
            yield pa.RecordBatch.from_arrays(columns, [k.name for k in self.fields])


class NpzBundles(DataSource):
    """Format ``npz_bundles``: option path; written with ``rows`` rows a file, read with the schema that is given or else that of the first file."""

    @classmethod
    def name(cls) -> str:
        return "npz_bundles"

    def schema(self) -> StructType:
        path = self.options["path"]
        first, _ = files_of(path, ".npz")[0]
        store, _ = located(path)
        fields = []
        with store.open_input_file(first) as f, zipfile.ZipFile(f) as z:
            for name in z.namelist():
                with z.open(name) as member:
                    version = np.lib.format.read_magic(member)
                    shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(member)
                one = from_arrow_type(pa.string() if kind.kind == "U" else pa.from_numpy_dtype(kind), prefer_timestamp_ntz=True)
                fields.append(StructField(name.removesuffix(".npy"), ArrayType(one) if len(shape) > 1 else one))
        return StructType(fields)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> StagedWriter:
        return _Writer(self.options["path"], overwrite, int(self.options.get("rows", 100_000)))


def write_bundles(df: DataFrame, path: str, rows: int = 100_000) -> None:
    """Rows as npz bundles; readers see all of them or the earlier ones. Nulls and ragged lists stop the write."""
    df.sparkSession.dataSource.register(NpzBundles)
    df.write.format("npz_bundles").option("path", path).option("rows", rows).mode("overwrite").save()


def read_bundles(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    spark.dataSource.register(NpzBundles)
    reader = spark.read.format("npz_bundles").option("path", path)
    return (reader.schema(schema) if schema else reader).load()
