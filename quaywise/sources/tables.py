"""Scans: Parquet, JSON, CSV and page text into typed tables."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder; columns are pruned by what is selected later."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def union_scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One scan over several files or folders whose schemas may differ by columns."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def overlap_scan(main: DataFrame, earlier: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``main`` and, where it lacks the key, of ``earlier``."""
    return main.unionByName(earlier.join(main.select(*key).distinct(), key, "left_anti"))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN in float columns becomes null; done once, where data come in."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(*[F.when(F.isnan(c), F.lit(None)).otherwise(F.col(c)).alias(c) if c in floats else F.col(c) for c in df.columns])


def first_present(text: Column, *names: str) -> Column:
    """The first of several spellings of a JSON field that is there."""
    return F.coalesce(*[F.get_json_object(text, f"$.{n}") for n in names])


def one_or_many(text: Column, schema: str) -> Column:
    """JSON records given as a list or as one object, always as an array; blank replies give an empty one."""
    body = F.trim(text)
    many = F.from_json(body, f"array<{schema}>")
    one = F.array(F.from_json(body, schema))
    return F.when(body.isNull() | (body == ""), F.array().cast(f"array<{schema}>")).when(body.startswith("["), many).otherwise(one)


def find_records(df: DataFrame, column: str, field: str) -> DataFrame:
    """Adds ``record``: one row for each object, however deep in the JSON, that has ``field``."""
    schema = df.withColumn("record", F.lit("")).schema

    def walk(node) -> Iterator[dict]:
        if isinstance(node, dict):
            if field in node:
                yield node
            else:
                for v in node.values():
                    yield from walk(v)
        elif isinstance(node, list):
            for v in node:
                yield from walk(v)

    def found(text: str | None) -> list[str]:
        try:
            return [json.dumps(r) for r in walk(json.loads(text or "null"))]
        except ValueError:
            return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(record=batch[column].map(found)).explode("record").dropna(subset=["record"])

    return df.mapInPandas(run, schema)


def number(text: Column) -> Column:
    """A number with thousands separators; null where there is none."""
    return F.regexp_replace(text, ",", "").try_cast("double")


def sum_present(*columns: Column) -> Column:
    """Sum of the columns that aren't null; null if all are."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in columns), F.lit(0.0))
    return F.when(F.coalesce(*columns).isNotNull(), total)


def plain_text(html: Column) -> Column:
    """Markup out, the common character references decoded, white space collapsed."""
    text = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</\\1>", " ")
    text = F.regexp_replace(text, "<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(text, "\\s+", " "))


def time_axis(spark: SparkSession, first: str, last: str, step: str) -> DataFrame:
    """Every ``step`` from ``first`` to ``last``, both included."""
    return spark.range(1).select(F.explode(F.expr(f"sequence(timestamp_ntz'{first}', timestamp_ntz'{last}', interval {step})")).alias("ts"))


def driven_scan(spark: SparkSession, index: DataFrame, root: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON folders of ``root`` named by an index (path, key columns): (records with the key columns, failures).

    Only the folders of the index are listed and read. Failures are (path, reason, n): folders
    without a file, and records that can't be read. Stops if there is no record at all.
    """
    named = [r[0] for r in index.select("path").distinct().collect()]  # an index: a row a folder
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    place = lambda path: hadoop.Path(f"{root}/{path}")
    there = [p for p in named if place(p).getFileSystem(conf).exists(place(p))]
    gone = spark.createDataFrame([(p, "no file", 1) for p in named if p not in set(there)], "path string, reason string, n long")
    if not there:
        raise ValueError(f"no record of the index can be read below {root}")
    lines = spark.read.text([f"{root}/{p}" for p in there]).filter("trim(value) <> ''")
    parsed = F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    files = lines.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2).alias("path"), parsed.alias("r")).select("path", "r.*")
    # one pass tells good from bad
    counts = files.groupBy("path").agg(F.count_if(F.col("_bad").isNotNull()).alias("n"), F.count(F.lit(1)).alias("all")).collect()  # a row a folder
    if not any(r["all"] > r["n"] for r in counts):
        raise ValueError(f"no record of the index can be read below {root}")
    bad = spark.createDataFrame([(r["path"], "unreadable record", r["n"]) for r in counts if r["n"]], "path string, reason string, n long")
    good = index.join(files.filter(F.col("_bad").isNull()).drop("_bad"), "path")
    return good, bad.unionByName(gone)


def same_place(expected: Column, found: Column, value: Column) -> Column:
    """``value`` where a record is from the place that its file is for; another place stops the query."""
    told = F.concat(F.lit("a record of "), F.coalesce(found.cast("string"), F.lit("nowhere")), F.lit(" in a file of "), expected.cast("string"))
    return F.when(expected.eqNullSafe(found), value).otherwise(F.raise_error(told))


def prices_and_days(text: Column) -> Column:
    """(low, high, first_day, last_day) from a sentence such as "March 4 to March 10: low $1.20, high $1,003.40"; nulls where it is none."""
    day = "([A-Z][a-z]+ [0-9]{1,2})"
    price = "\\$([0-9,]+(?:\\.[0-9]+)?)"
    pattern = f"{day} to {day}[^$]*{price}[^$]*{price}"
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    return F.struct(number(part(3)).alias("low"), number(part(4)).alias("high"), part(1).alias("first_day"), part(2).alias("last_day"))


_LETTERS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def read_workbooks(spark: SparkSession, path: str, skip: int = 0) -> DataFrame:
    """(path, sheet, row, cells) of the sheets of xlsx workbooks, which may stand in zip archives; ``skip`` first rows are left out.

    A workbook is read in one task. Cells are text; empty ones inside a row are null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                rows = [(name, *r) for r in _workbook_rows(io.BytesIO(content)) if r[1] > skip]
                yield pd.DataFrame(rows, columns=["path", "sheet", "row", "cells"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, sheet int, row int, cells array<string>")


def _workbook_rows(file: io.BytesIO) -> Iterator[tuple[int, int, list[str | None]]]:
    with zipfile.ZipFile(file) as z:
        names = z.namelist()
        for inner in sorted(n for n in names if n.endswith(".xlsx")):
            yield from _workbook_rows(io.BytesIO(z.read(inner)))
        shared = [] if "xl/sharedStrings.xml" not in names else ["".join(t.text or "" for t in s.iter(f"{_LETTERS}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheets = sorted((int("".join(filter(str.isdigit, n.rsplit("/", 1)[1]))), n) for n in names if n.startswith("xl/worksheets/sheet"))
        for number_, name in sheets:
            for row in ElementTree.fromstring(z.read(name)).iter(f"{_LETTERS}row"):
                cells: dict[int, str | None] = {}
                for c in row:
                    column = 0
                    for letter in c.get("r").rstrip("0123456789"):
                        column = column * 26 + ord(letter) - 64
                    value = c.find(f"{_LETTERS}v")
                    text = value.text if value is not None else "".join(t.text or "" for t in c.iter(f"{_LETTERS}t")) or None
                    cells[column] = shared[int(text)] if c.get("t") == "s" and text is not None else text
                if cells:
                    yield number_, int(row.get("r")), [cells.get(k) for k in range(1, max(cells) + 1)]


def polygons(text: DataFrame, column: str, zone: str) -> DataFrame:
    """(zone, part, ring, points) of the polygons and multipolygons of GeoJSON feature collections; ring 0 is the outer one."""
    schema = "struct<features: array<struct<properties: map<string, string>, geometry: struct<type: string, coordinates: string>>>>"
    found = text.select(F.explode(F.from_json(column, schema)["features"]).alias("f"))
    shape, many = F.col("f.geometry.coordinates"), "array<array<array<array<double>>>>"
    parts = F.when(F.col("f.geometry.type") == "Polygon", F.from_json(F.concat(F.lit("["), shape, F.lit("]")), many)).otherwise(F.from_json(shape, many))
    rings = found.select(F.col("f.properties")[zone].alias("zone"), F.posexplode(parts).alias("part", "_rings")).select("zone", "part", F.posexplode("_rings").alias("ring", "points"))
    return rings


def ring_area(points: Column) -> Column:
    """Area inside a closed ring of [x, y] points."""
    twice = F.aggregate(F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1), lambda a, b: a[0] * b[1] - b[0] * a[1]), F.lit(0.0), lambda s, v: s + v)
    return F.abs(twice) / 2


def inside_ring(x: Column, y: Column, points: Column) -> Column:
    """Whether a ray from (x, y) crosses a closed ring an odd number of times."""
    crosses = lambda a, b: ((a[1] > y) != (b[1] > y)) & (x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0])
    sides = F.zip_with(F.slice(points, F.lit(1), F.size(points) - 1), F.slice(points, F.lit(2), F.size(points) - 1), lambda a, b: F.when(a[1] != b[1], crosses(a, b).cast("int")).otherwise(F.lit(0)))
    return F.aggregate(sides, F.lit(0), lambda s, v: s + v) % 2 == 1
