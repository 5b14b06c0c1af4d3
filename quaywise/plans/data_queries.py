"""Queries: sources, sinks, arrays, quality control, streams."""

from __future__ import annotations

import io
import json
import struct
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from ..operators import qc
from ..operators import spatial as sx
from ..sources import bundles, configs, grids, records, sinks
from ..sources import tables as src
from ..sources.tables import table
from .common import H, folder, hourly, rounded
from .registry import query


@query("src1_pruned_scan", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def src1(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_quantity").filter("l_quantity > 45")


@query("src2_union_scan", "SELECT n_name, NULL AS r_name FROM nation UNION ALL SELECT NULL, r_name FROM region")
def src2(spark, sf):
    return src.union_scan(spark, [f"{sf}/nation.parquet", f"{sf}/region.parquet"]).select("n_name", "r_name")


@query("src3_overlap_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) >= 1998 UNION ALL SELECT o_orderkey, -o_totalprice FROM orders WHERE year(o_orderdate) = 1997")
def src3(spark, sf):
    o = table(spark, sf, "orders")
    main = o.filter(F.year("o_orderdate") >= 1998).select("o_orderkey", "o_totalprice")
    earlier = o.filter(F.year("o_orderdate").between(1997, 1998)).select("o_orderkey", (-F.col("o_totalprice")).alias("o_totalprice"))
    return src.overlap_scan(main, earlier, ["o_orderkey"])


@query("src4_find_records", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def src4(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit('{"reply": {"items": ['), "props", F.lit("]}}")).alias("raw"))
    return src.find_records(e, "raw", "k").select("event_id", F.get_json_object("record", "$.k").cast("long").alias("k"))


@query("src5_first_present", "SELECT event_id, coalesce(json_extract_string(props, '$.kk'), json_extract_string(props, '$.k')) AS k FROM events")
def src5(spark, sf):
    return table(spark, sf, "events").select("event_id", src.first_present(F.col("props"), "kk", "k").alias("k"))


@query("src6_one_or_many", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 3 <> 2")
def src6(spark, sf):
    e = table(spark, sf, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("["), "props", F.lit("]"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.lit(""))
    return e.select("event_id", F.explode(src.one_or_many(raw, "struct<k:bigint>")).alias("r")).select("event_id", "r.k")


@query("src7_flatten", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def src7(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "struct<k:bigint>").alias("p")).select("event_id", "p.*")


def _event_files(spark, sf, out):
    """Events as JSON in a folder for each of four parts; one record in fifty of part 2 is broken."""
    line = F.when((F.col("event_id") % 4 == 2) & (F.col("event_id") % 50 == 2), F.lit('{"event_id": 1')).otherwise(F.to_json(F.struct("event_id", "value", (F.col("event_id") % 4).alias("place"))))
    table(spark, sf, "events").select((F.col("event_id") % 4).alias("part"), line.alias("value")).write.partitionBy("part").text(out)
    return spark.createDataFrame([(f"part={k}", k) for k in (0, 2, 3, 7)], "path string, expected long")


@query("src8_driven_scan", "SELECT 'part=' || event_id % 4 AS path, NULL AS reason, count(*) AS n FROM events WHERE event_id % 4 IN (0, 2, 3) AND NOT (event_id % 4 = 2 AND event_id % 50 = 2) GROUP BY 1 UNION ALL SELECT 'part=2', 'unreadable record', count(*) FROM events WHERE event_id % 4 = 2 AND event_id % 50 = 2 UNION ALL SELECT 'part=7', 'no file', 1")
def src8(spark, sf):
    out = folder(spark)
    good, failures = src.driven_scan(spark, _event_files(spark, sf, out), out, "event_id long, value double, place long")
    counts = good.groupBy("path").agg(F.lit(None).cast("string").alias("reason"), F.count(F.lit(1)).alias("n"))
    return counts.unionByName(failures)


@query("src9_location_check", "SELECT event_id % 4 AS place, count(*) AS n, round(sum(value), 4) AS value FROM events WHERE event_id % 4 IN (0, 2, 3) AND NOT (event_id % 4 = 2 AND event_id % 50 = 2) GROUP BY 1")
def src9(spark, sf):
    out = folder(spark)
    good, _ = src.driven_scan(spark, _event_files(spark, sf, out), out, "event_id long, value double, place long")
    checked = good.select(src.same_place(F.col("expected"), F.col("place"), F.col("place")).alias("place"), "value")
    return rounded(checked.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")), "value", digits=4)


@query("src10_csv_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def src10(spark, sf):
    out = folder(spark)
    sinks.write_csv(table(spark, sf, "orders").select("o_orderkey", F.date_format("o_orderdate", "MM/dd/yyyy").alias("day")), out)
    return spark.read.option("header", "true").option("dateFormat", "MM/dd/yyyy").schema("o_orderkey long, day date").csv(out)


@query("src11_thousands", "SELECT c_custkey, round(c_acctbal, 2) AS amount FROM customer")
def src11(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.format_number("c_acctbal", 2).alias("a"), F.lit("n/a").alias("b"))
    return rounded(c.select("c_custkey", src.sum_present(src.number(F.col("a")), src.number(F.col("b"))).alias("amount")), "amount", digits=2)


@query("src13_page_text", "SELECT c_custkey, round(abs(c_acctbal), 2) AS low, round(abs(c_acctbal) + 1234.5, 2) AS high, 'March ' || (1 + c_custkey % 20) AS first_day, 'April ' || (1 + c_custkey % 9) AS last_day FROM customer")
def src13(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    money = lambda x: F.concat(F.lit("<b>$"), F.format_number(x, 2), F.lit("</b>"))
    page = F.concat(F.lit("<html><style>b{}</style><p>Week of March&nbsp;"), 1 + k % 20, F.lit("\n to <i>April "), 1 + k % 9, F.lit("</i>: low "), money(F.abs("c_acctbal")), F.lit(", high "), money(F.abs("c_acctbal") + 1234.5), F.lit("</p>"))
    found = c.select("c_custkey", src.prices_and_days(src.plain_text(page)).alias("x"))
    return rounded(found.select("c_custkey", "x.*"), "low", "high", digits=2)


def _put(spark, path: str, content: bytes) -> str:
    """A file of a query's own in the shared place."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark._jsc.hadoopConfiguration()).create(p)
    out.write(bytearray(content))
    out.close()
    return path


def _workbook(rows: list[list], heading: str) -> bytes:
    """A small xlsx file: a heading row, then rows of numbers and texts."""
    cells = lambda r, n: "".join(f'<c r="{chr(65 + k)}{n}"><v>{v}</v></c>' if isinstance(v, int) else f'<c r="{chr(65 + k)}{n}" t="inlineStr"><is><t>{escape(v)}</t></is></c>' for k, v in enumerate(r) if v is not None)
    body = "".join(f'<row r="{n}">{cells(r, n)}</row>' for n, r in enumerate([[heading], *rows], 1))
    sheet = f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'
    file = io.BytesIO()
    with zipfile.ZipFile(file, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    return file.getvalue()


@query("src12_workbook", "SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name, CAST(n_regionkey AS INT) AS n_regionkey FROM nation WHERE n_name IS NOT NULL")
def src12(spark, sf):
    rows = [list(r) for r in table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]  # 25 rows
    place, archive = folder(spark), io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("nations.xlsx", _workbook(rows[:12], "Nations"))
    _put(spark, f"{place}/first.zip", archive.getvalue())
    _put(spark, f"{place}/second.xlsx", _workbook(rows[12:], "Nations"))
    cells = F.col("cells")
    return src.read_workbooks(spark, place, skip=1).filter(cells[1].isNotNull()).select(cells[0].cast("int").alias("n_nationkey"), cells[1].alias("n_name"), cells[2].cast("int").alias("n_regionkey"))


#: Number and sum of events by type and hour, as messages of a type at an hour of January.
MESSAGES = "SELECT event_type AS name, CAST(date_diff('hour', TIMESTAMP '2024-01-01', date_trunc('hour', ts)) AS VARCHAR) AS level, count(*) AS n, round(sum(value), 5) AS total FROM events WHERE event_type IN ('click', 'purchase') GROUP BY 1, 2"


def _messages(spark, sf, codes):
    """Files of one message for each type and hour: its category is the type, its section 7 the figures."""
    sums = table(spark, sf, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    level = F.expr("cast(timestampdiff(hour, timestamp_ntz'2024-01-01', cast(hour as timestamp_ntz)) as int)")

    @F.pandas_udf("binary")
    def message(kind: pd.Series, hour: pd.Series, n: pd.Series, total: pd.Series) -> pd.Series:
        return pd.Series([records.framed((0, codes[k], 0), (100, h), struct.pack(">qd", c, t)) for k, h, c, t in zip(kind, hour, n, total)])

    rows = sums.filter(F.col("event_type").isin(*codes)).withColumn("level", level)
    out = folder(spark)
    records.write_messages(rows.select(F.col("event_type").alias("name"), "level", message("event_type", "level", "n", "total").alias("message")), out)
    return out


def _figures(messages):
    """(name, level, n, total) of messages."""

    @F.pandas_udf("n long, total double")
    def opened(message: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([struct.unpack(">qd", records.payload(m)) for m in message], columns=["n", "total"])

    return rounded(messages.select("name", "level", opened("message").alias("x")).select("name", "level", "x.*"), "total", digits=5)


#: What the types of events are in the messages' headers.
TYPES = {"click": 1, "purchase": 2, "view": 3, "signup": 4, "error": 5}


@query("src15_indexed_records", MESSAGES)
def src15(spark, sf):
    """Only the messages of two names are read, at the places that the indexes give."""
    return _figures(records.read_messages(spark, _messages(spark, sf, TYPES), names="click,purchase"))


@query("src15_header_walk", MESSAGES)
def src15_walk(spark, sf):
    """Without the indexes: headers are walked from the first message of each stretch."""
    names = {f"0.{k}.0": n for n, k in TYPES.items()}
    found = records.read_messages(spark, _messages(spark, sf, TYPES), index="", codes=json.dumps(names), names="click,purchase", stretch="20000")
    return _figures(found.withColumn("level", F.substring_index("level", ":", -1)))


#: Events by hour and cell of a grid; a file a day.
GRID = "g AS (SELECT CAST(ts AS DATE) AS day, date_trunc('hour', ts) AS time, 40 + (user_id % 12) * 0.5 AS lat, -75 + (event_id % 10) * 0.625 AS lon, sum(value) AS total, count(*) AS n FROM events GROUP BY 1, 2, 3, 4)"


def _grid_files(spark, sf, levels: bool = False):
    e = table(spark, sf, "events")
    cell = [(40 + (F.col("user_id") % 12) * 0.5).alias("lat"), (-75 + (F.col("event_id") % 10) * 0.625).alias("lon")]
    level = [F.element_at(F.array(F.lit(850.0), F.lit(500.0), F.lit(250.0)), (F.col("event_id") % 3 + 1).cast("int")).alias("lev")] if levels else []
    day = F.date_format("ts", "'grid-'yyyy-MM-dd").alias("file")
    sums = e.groupBy(day, F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("time"), *level, *cell).agg(F.sum("value").alias("total"), F.count(F.lit(1)).cast("double").alias("n"))
    out = folder(spark)
    grids.write_grids(sums, out)
    return out


@query("src14_grid_scan", f"WITH {GRID} SELECT time, lat, lon, round(total, 5) AS total, CAST(n AS DOUBLE) AS n FROM g WHERE lat BETWEEN 41 AND 43 AND lon BETWEEN -74 AND -71")
def src14(spark, sf):
    """A box of the grids of all days, cells without events left out."""
    cells = grids.read_grids(spark, _grid_files(spark, sf), box="41,43,-74,-71").filter("n is not null")
    return rounded(cells.select("time", "lat", "lon", "total", "n"), "total", digits=5)


@query("arr1_level_subset", "SELECT CASE event_id % 3 WHEN 0 THEN 850.0 ELSE 250.0 END AS lev, CAST(CASE event_id % 3 WHEN 0 THEN 1 ELSE 0 END AS INT) AS place, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE event_id % 3 <> 1 GROUP BY 1, 2")
def arr1_levels(spark, sf):
    """Two levels of three, in the order asked for; ``place`` is the order in which a file's first time has them."""
    cells = grids.read_grids(spark, _grid_files(spark, sf, levels=True), levels="250,850").filter("n is not null")
    order = F.when(F.col("lev") == 250.0, 0).otherwise(1).alias("place")
    return cells.groupBy(F.col("lev").cast("double").alias("lev"), order).agg(F.sum("n").cast("long").alias("n"), F.round(F.sum("total"), 4).alias("total"))


@query("src18_config_scan", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE event_type IN ('click', 'view') AND value >= 10.5 GROUP BY 1")
def src18(spark, sf):
    """What is read, and from which value on, stands in a configuration file."""
    text = json.dumps({"events": {"types": ["click", "view"], "value": {"least": 10.5}}}, indent=1)
    config = configs.read_config(spark, _put(spark, f"{folder(spark)}/events.yaml", text.encode()))
    types, least = configs.setting(config, "events", "types"), configs.setting(config, "events", "value", "least")
    e = table(spark, sf, "events").filter(F.col("event_type").isin(types) & (F.col("value") >= least))
    return rounded(e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")), "mean")


SHAPES = "s AS (SELECT r_name AS zone, r_regionkey * 10.0 AS x FROM region)"


def _shapes(spark, sf):
    """One feature a region: a square of side 4 with a square hole of side 1, and a triangle beside it."""
    square = lambda x, y, a: F.array(*[F.array(x + dx * a, y + F.lit(dy * a)) for dx, dy in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))])
    x, zero = F.col("r_regionkey") * 10.0, F.lit(0.0)
    hole, triangle = square(x + 1, F.lit(1.0), 1.0), F.array(F.array(x + 5, zero), F.array(x + 7, zero), F.array(x + 5, F.lit(2.0)), F.array(x + 5, zero))
    shape = F.struct(F.lit("MultiPolygon").alias("type"), F.array(F.array(square(x, zero, 4.0), hole), F.array(triangle)).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("r_name").alias("name")).alias("properties"), shape.alias("geometry"))
    return table(spark, sf, "region").select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("text"))


@query("src19_polygon_areas", f"WITH {SHAPES} SELECT zone, 4.0 * 4 - 1 + 2 AS area, CAST(2 AS BIGINT) AS parts FROM s")
def src19(spark, sf):
    rings = src.polygons(_shapes(spark, sf), "text", "name").withColumn("area", src.ring_area(F.col("points")))
    signed = F.when(F.col("ring") == 0, F.col("area")).otherwise(-F.col("area"))
    return rings.groupBy("zone").agg(F.sum(signed).alias("area"), F.countDistinct("part").alias("parts"))


@query("src19_points_in_polygons", f"WITH {SHAPES}, p AS (SELECT event_id, (event_id % 500) / 10.0 + 0.05 AS x, (user_id % 40) / 10.0 + 0.03 AS y FROM events) SELECT zone, count(*) AS n FROM s JOIN p ON (p.x > s.x AND p.x < s.x + 4 AND p.y > 0 AND p.y < 4 AND NOT (p.x > s.x + 1 AND p.x < s.x + 2 AND p.y > 1 AND p.y < 2)) OR (p.x > s.x + 5 AND p.y > 0 AND (p.x - s.x - 5) + p.y < 2) GROUP BY 1")
def src19_points(spark, sf):
    rings = src.polygons(_shapes(spark, sf), "text", "name")
    e = table(spark, sf, "events").select("event_id", ((F.col("event_id") % 500) / 10 + 0.05).alias("x"), ((F.col("user_id") % 40) / 10 + 0.03).alias("y"))
    return sx.points_in_polygons(e, rings, "x", "y", 1.0).groupBy("zone").agg(F.count(F.lit(1)).alias("n"))


def _map(spark, sf, side):
    """Each customer's nation as a square of a map, five in a row; regions are the zones."""
    c = table(spark, sf, "customer").select("c_nationkey").distinct()
    n = c.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    x, y = (F.col("n_nationkey") % 5).cast("double"), F.floor(F.col("n_nationkey") / 5).cast("double")
    corner = lambda a, b: F.array(x + a, y + b)
    ring = F.array(corner(0.0, 0.0), corner(side, 0.0), corner(side, side), corner(0.0, side), corner(0.0, 0.0))
    return n.select(F.col("n_regionkey").alias("zone"), F.col("n_nationkey").alias("part"), F.lit(0).alias("ring"), ring.alias("points"))


MAP = "m AS (SELECT DISTINCT n_regionkey AS zone, n_nationkey % 5 AS x, n_nationkey // 5 AS y FROM nation JOIN customer ON c_nationkey = n_nationkey)"


@query("src19_outlines", f"WITH {MAP} SELECT zone, CAST(4 * count(*) - 2 * (SELECT count(*) FROM m a JOIN m b ON a.zone = b.zone AND a.zone = o.zone AND (b.x = a.x + 1 AND b.y = a.y OR b.x = a.x AND b.y = a.y + 1)) AS BIGINT) AS sides FROM m o GROUP BY zone")
def src19_outlines(spark, sf):
    """Sides of the regions' shapes after the nations in them have dissolved."""
    return sx.outlines(_map(spark, sf, 1.0)).groupBy("zone").agg(F.count(F.lit(1)).alias("sides"))


@query("src19_union_areas", f"WITH {MAP}, h AS (SELECT DISTINCT zone, 2 * x + i AS i, 2 * y + j AS j FROM m, range(3) a(i), range(3) b(j)) SELECT zone, count(*) / 4.0 AS area FROM h GROUP BY 1")
def src19_unions(spark, sf):
    """Area of each region, whose nations overlap by half a side."""
    return sx.union_areas(_map(spark, sf, 1.5)).select("zone", F.round("area", 6).alias("area"))


@query("src17_array_scan", "SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS x0, len(embedding) AS n FROM embeddings")
def src17(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.col("embedding")[0].cast("double").alias("x0"), F.size("embedding").cast("long").alias("n"))


@query("src20_time_axis", "WITH a AS (SELECT unnest(generate_series(date_trunc('day', (SELECT min(ts) FROM events)), (SELECT max(ts) FROM events), INTERVAL 3 HOUR)) AS ts) SELECT a.ts, count(event_id) AS n FROM a LEFT JOIN events e ON e.ts >= a.ts AND e.ts < a.ts + INTERVAL 3 HOUR GROUP BY 1")
def src20(spark, sf):
    """The axis over the events' time, with the events of each step."""
    e = table(spark, sf, "events").select("event_id", "ts")
    first, last = e.agg(F.date_trunc("day", F.min("ts")).cast("string"), F.max("ts").cast("string")).head()
    axis = src.time_axis(spark, first, last, "3 hours")
    day = F.date_trunc("day", "ts").cast("timestamp_ntz")
    step = F.timestamp_add("HOUR", F.floor(F.hour("ts") / 3).cast("int") * 3, day)
    counts = e.groupBy(step.alias("ts")).agg(F.count("event_id").alias("n"))
    return axis.join(counts, "ts", "left").select("ts", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query("snk1_partitioned_write", f"WITH {H} SELECT zone, count(*) AS n FROM h GROUP BY 1")
def snk1(spark, sf):
    out = folder(spark)
    sinks.write_partitioned(hourly(spark, sf), out, ["zone"])
    return spark.read.parquet(out).groupBy(F.col("zone").cast("string").alias("zone")).agg(F.count(F.lit(1)).alias("n"))


@query("snk2_progress_write", f"WITH {H} SELECT zone, 'a' AS run, count(*) AS n FROM h GROUP BY 1 UNION ALL SELECT zone, 'b', count(*) FROM h GROUP BY 1")
def snk2(spark, sf):
    out, h = folder(spark), hourly(spark, sf)
    for run in ("a", "b", "a"):  # repeated: the partition is replaced, not doubled
        sinks.write_progress(h, out, {"run": run})
    return spark.read.parquet(out).groupBy("zone", "run").agg(F.count(F.lit(1)).alias("n"))


@query("snk4_resume", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def snk4(spark, sf):
    out, o = folder(spark), table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    qc.write_missing(o.filter("o_orderstatus = 'F'"), out, ["o_orderstatus"])
    qc.write_missing(o, out, ["o_orderstatus"])
    return spark.read.parquet(out).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("snk5_sidecar", f"WITH {H} SELECT 'hourly' AS content, count(*) AS n, (SELECT count(*) FROM h) AS stated FROM h")
def snk5(spark, sf):
    out, h = folder(spark), hourly(spark, sf)
    sinks.write_with_sidecar(h, out, {"content": "hourly", "rows": h.count()})
    facts = sinks.read_sidecar(spark, out)
    return spark.read.parquet(f"{out}/data").agg(F.count(F.lit(1)).alias("n")).select(F.lit(facts["content"]).alias("content"), "n", F.lit(facts["rows"]).cast("long").alias("stated"))


@query("snk5_npz_bundles", "SELECT vec_id, label, len(embedding) AS wide, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def snk5_npz(spark, sf):
    """Arrays written as npz bundles and read back."""
    out = folder(spark)
    bundles.write_bundles(table(spark, sf, "embeddings").select("vec_id", "label", "embedding"), out, rows=500)
    found = bundles.read_bundles(spark, out)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return rounded(found.select("vec_id", "label", F.size("embedding").cast("long").alias("wide"), total.alias("total")), "total", digits=4)


@query("snk7_report", "SELECT o_orderstatus, " + ", ".join(f"round(avg(CASE WHEN year(o_orderdate) = {y} THEN o_totalprice END), 4) AS y{y}" for y in (1996, 1997, 1998)) + " FROM orders GROUP BY 1")
def snk7(spark, sf):
    o = table(spark, sf, "orders").withColumn("year", F.concat(F.lit("y"), F.year("o_orderdate").cast("string")))
    return rounded(sinks.report(o, "o_orderstatus", "year", "o_totalprice", ["y1996", "y1997", "y1998"]), "y1996", "y1997", "y1998", digits=4)


# A small grid whose cells carry the hourly panel: latitude by event, longitude by user.
CELLS = "c AS (SELECT CAST(user_id % 12 AS INT) AS row, CAST(event_id % 10 AS INT) AS col, 40 + (user_id % 12) * 0.5 AS lat, -75 + (event_id % 10) * 0.625 AS lon, value FROM events)"
BOXES = [("north", 43.0, 46.0, -75.0, -72.0), ("south", 40.0, 42.0, -74.0, -70.0), ("all", 40.0, 46.0, -75.0, -69.0)]
BOX_SQL = "b(box, lat_min, lat_max, lon_min, lon_max) AS (VALUES " + ", ".join(f"('{b[0]}', {b[1]}, {b[2]}, {b[3]}, {b[4]})" for b in BOXES) + ")"


def _cells(spark, sf):
    e = table(spark, sf, "events")
    r, c = (F.col("user_id") % 12).cast("int"), (F.col("event_id") % 10).cast("int")
    return e.select(r.alias("row"), c.alias("col"), (40 + r * 0.5).alias("lat"), (-75 + c * 0.625).alias("lon"), "value")


def _boxes(spark):
    return spark.createDataFrame(BOXES, "box string, lat_min double, lat_max double, lon_min double, lon_max double")


@query("snk6_boxes_in_one_scan", f"WITH {CELLS}, {BOX_SQL} SELECT box, count(*) AS n FROM c JOIN b ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max GROUP BY 1")
def snk6(spark, sf):
    out = folder(spark)
    sinks.write_boxes(_cells(spark, sf), _boxes(spark), out)
    return spark.read.parquet(out).groupBy("box").agg(F.count(F.lit(1)).alias("n"))


@query("arr1_box_crop", f"WITH {CELLS} SELECT row, col, count(*) AS n FROM c WHERE lat BETWEEN 41 AND 43 AND lon BETWEEN -74 AND -71 GROUP BY 1, 2")
def arr1(spark, sf):
    return _cells(spark, sf).filter(sx.in_box(F.col("lat"), F.col("lon"), (41.0, 43.0, -74.0, -71.0))).groupBy("row", "col").agg(F.count(F.lit(1)).alias("n"))


@query("arr2_snap_box", f"WITH {CELLS} SELECT CAST(floor((41.2 - 40) / 0.5 + 0.5) AS INT) AS r0, CAST(floor((43.6 - 40) / 0.5 + 0.5) AS INT) AS r1, CAST(floor((-74.2 + 75) / 0.625 + 0.5) AS INT) AS c0, CAST(floor((-70.9 + 75) / 0.625 + 0.5) AS INT) AS c1, count(*) AS n FROM c WHERE row BETWEEN 2 AND 7 AND col BETWEEN 1 AND 7")
def arr2(spark, sf):
    r0, r1, c0, c1 = sx.snap_box((41.2, 43.6, -74.2, -70.9), (40.0, -75.0), (0.5, 0.625))
    n = _cells(spark, sf).filter(F.col("row").between(r0, r1) & F.col("col").between(c0, c1)).agg(F.count(F.lit(1)).alias("n"))
    return n.select(*[F.lit(v).alias(k) for k, v in (("r0", r0), ("r1", r1), ("c0", c0), ("c1", c1))], "n")


@query("arr3_box_mean", f"WITH {CELLS}, {BOX_SQL} SELECT box, round(avg(value), 6) AS mean FROM c JOIN b ON lat >= lat_min AND lat <= lat_max AND lon >= lon_min AND lon <= lon_max GROUP BY 1")
def arr3(spark, sf):
    cells = _cells(spark, sf)
    inside = sx.cells_in_boxes(cells.select("row", "col", "lat", "lon").distinct(), _boxes(spark))
    return rounded(cells.join(inside.select("row", "col", "box"), ["row", "col"]).groupBy("box").agg(F.avg("value").alias("mean")), "mean")


@query("arr4_speed_of_means", f"WITH {CELLS}, {BOX_SQL} SELECT box, round(sqrt(power(avg(value), 2) + power(avg(value - 20), 2)), 6) AS speed FROM c JOIN b ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max GROUP BY 1")
def arr4(spark, sf):
    inside = sx.cells_in_boxes(_cells(spark, sf), _boxes(spark))
    return rounded(inside.groupBy("box").agg(F.hypot(F.avg("value"), F.avg(F.col("value") - 20)).alias("speed")), "speed")


@query("arr5_patch_window", f"WITH {CELLS} SELECT row, col, round(avg(value), 6) AS mean FROM c WHERE row BETWEEN 0 AND 1 AND col BETWEEN 4 AND 6 GROUP BY 1, 2")
def arr5(spark, sf):
    return rounded(sx.patch_window(_cells(spark, sf), 0, 5, 1, 12, 10).groupBy("row", "col").agg(F.avg("value").alias("mean")), "mean")


@query("arr6_pixel_window", f"WITH {CELLS} SELECT count(*) AS n FROM c WHERE row BETWEEN 2 AND 5 AND col BETWEEN 4 AND 7")
def arr6(spark, sf):
    return _cells(spark, sf).filter(F.col("row").between(2 * 1, 2 * 2 + 1) & F.col("col").between(2 * 2, 2 * 3 + 1)).agg(F.count(F.lit(1)).alias("n"))


@query("arr7_bilinear", f"WITH {CELLS}, g AS (SELECT row, col, avg(value) AS v FROM c GROUP BY 1, 2), p AS (SELECT CAST(n_nationkey AS INT) AS id, (n_nationkey * 0.37) % 10 AS r, (n_nationkey * 0.61) % 8 AS c FROM nation) SELECT id, round(sum(v * (1 - abs(p.r - g.row)) * (1 - abs(p.c - g.col))), 3) AS v FROM p JOIN g ON g.row BETWEEN floor(p.r) AND floor(p.r) + 1 AND g.col BETWEEN floor(p.c) AND floor(p.c) + 1 GROUP BY 1")
def arr7(spark, sf):
    g = _cells(spark, sf).groupBy("row", "col").agg(F.avg("value").alias("v"))
    k = F.col("n_nationkey")
    points = table(spark, sf, "nation").select(k.cast("int").alias("id"), (k * 0.37 % 10).alias("r"), (k * 0.61 % 8).alias("c"))
    return rounded(sx.bilinear(points, g, "v"), "v", digits=3)


@query("arr8_retile", "SELECT vec_id, CAST((vec_id // 16) // 5 * 4 + (vec_id % 16) // 4 AS INT) AS row, CAST((vec_id // 16) % 5 * 4 + (vec_id % 16) % 4 AS INT) AS col FROM embeddings")
def arr8(spark, sf):
    row, col = sx.retile(F.floor(F.col("vec_id") / 16), F.col("vec_id") % 16, 5, 4, 4)
    return table(spark, sf, "embeddings").select("vec_id", row.alias("row"), col.alias("col"))


@query("arr9_regrid", f"WITH {CELLS} SELECT CAST(least(greatest(floor((lat - 40) / 1.5), 0), 3) AS INT) AS r, CAST(least(greatest(floor((lon + 75) / 2.0), 0), 2) AS INT) AS k, round(avg(value), 6) AS v FROM c GROUP BY 1, 2")
def arr9(spark, sf):
    r, k = sx.regrid(F.col("lat"), F.col("lon"), 40.0, -75.0, (1.5, 2.0), 4, 3)
    return rounded(_cells(spark, sf).groupBy(r.alias("r"), k.alias("k")).agg(F.avg("value").alias("v")), "v")


@query("arr10_channel_slice", "SELECT vec_id, CAST(embedding[20] AS DOUBLE) AS last_of_first, CAST(embedding[21] AS DOUBLE) AS first_of_rest FROM embeddings")
def arr10(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.element_at(F.slice("embedding", 1, 20), 20).cast("double").alias("last_of_first"), F.slice("embedding", 21, 44)[0].cast("double").alias("first_of_rest"))


@query("arr11_concat", "SELECT vec_id, CAST(len(list_concat(embedding[1:8], embedding[33:40])) AS INT) AS n, CAST(list_concat(embedding[1:8], embedding[33:40])[9] AS DOUBLE) AS ninth FROM embeddings")
def arr11(spark, sf):
    both = F.concat(F.slice("embedding", 1, 8), F.slice("embedding", 33, 8))
    return table(spark, sf, "embeddings").select("vec_id", F.size(both).alias("n"), both[8].cast("double").alias("ninth"))


@query("arr12_normalised_guard", "WITH x AS (SELECT unnest(range(1, 65)) AS i, unnest(embedding) AS v FROM embeddings), m AS (SELECT i, avg(v) AS mu, stddev_pop(v) AS sd FROM x GROUP BY 1) SELECT CAST(x.i - 1 AS INT) AS channel, round(avg(abs((v - mu) / sd)), 5) AS mean_abs_z, avg(abs((v - mu) / sd)) <= 20 AS ok FROM x JOIN m ON x.i = m.i GROUP BY 1")
def arr12(spark, sf):
    x = table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("channel", "v")).withColumn("v", F.col("v").cast("double"))
    m = x.groupBy("channel").agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("sd"))  # a row a channel
    z = F.avg(F.abs((F.col("v") - F.col("mu")) / F.col("sd")))
    return rounded(x.join(m, "channel").groupBy("channel").agg(z.alias("mean_abs_z"), (z <= 20).alias("ok")), "mean_abs_z", digits=5)


@query("arr13_pca_share")
def arr13(spark, sf):
    e = table(spark, sf, "embeddings")
    pca = sx.Pca(e.filter("vec_id % 5 <> 0"), "embedding", 5)
    scores = pca.transform(e, "embedding")
    return scores.select("vec_id", "label", F.posexplode("pc").alias("component", "score")).groupBy("label", "component").agg(F.avg("score").alias("mean"), F.stddev_pop("score").alias("sd"))


@query("arr14_shared_basis_pca")
def arr14(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("patches", F.array(F.slice("embedding", 1, 32), F.slice("embedding", 33, 32))).select("vec_id", F.posexplode("patches").alias("patch", "v"))
    pca = sx.Pca(e.filter("vec_id % 5 <> 0"), "v", 3)
    return pca.transform(e, "v").select("vec_id", "patch", *[F.col("pc")[k].alias(f"pc{k}") for k in range(3)])


@query("arr15_gram_pca")
def arr15(spark, sf):
    """Few rows, many fields: one row a label here."""
    return sx.gram_pca(sx.vector_mean(table(spark, sf, "embeddings"), ["label"], "embedding"), "label", "embedding", 3)


@query("arr16_component_sweep")
def arr16(spark, sf):
    """A ridge probe of the label on the first 2, 4 and 8 components: errors on the held-out fifth by number of components."""
    from ..operators.evaluate import errors_by
    from ..operators.models import Linear

    e = table(spark, sf, "embeddings").select("vec_id", "embedding", F.col("label").cast("double").alias("y"), (F.col("vec_id") % 5 == 0).alias("held_out"))
    scores = sx.Pca(e.filter("not held_out"), "embedding", 8).transform(e, "embedding")
    columns = scores.select("y", "held_out", *[F.col("pc")[k].alias(f"pc{k}") for k in range(8)])
    fits = {k: Linear([f"pc{j}" for j in range(k)], 1.0).fit(columns.filter("not held_out")) for k in (2, 4, 8)}
    parts = [fit.predict(columns.filter("held_out")).select(F.lit(k).alias("components"), "y", "yhat") for k, fit in fits.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).transform(errors_by, ["components"])


@query("arr17_linear_r2", "WITH x AS (SELECT CAST(embedding[3] AS DOUBLE) AS y, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b FROM embeddings), c AS (SELECT count(*) AS n, corr(y, a) AS ya, corr(y, b) AS yb, corr(a, b) AS ab FROM x) SELECT n, round((ya * ya + yb * yb - 2 * ya * yb * ab) / (1 - ab * ab), 6) AS r2 FROM c")
def arr17(spark, sf):
    """Share of one pooled input that a linear map of two others explains."""
    from ..operators.evaluate import errors_by
    from ..operators.models import Linear

    at = lambda k, n: F.col("embedding")[k].cast("double").alias(n)
    x = table(spark, sf, "embeddings").select(at(2, "y"), at(0, "a"), at(1, "b"), F.lit(1).alias("one"))
    found = Linear(["a", "b"]).fit(x).predict(x).transform(errors_by, ["one"])
    return rounded(found.select("n", "r2"), "r2")


@query("arr18_ridge_probe")
def arr18(spark, sf):
    from ..operators.evaluate import errors
    from ..operators.models import Linear

    x = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("double").alias("y"), *[F.col("embedding")[k].cast("double").alias(f"x{k}") for k in range(16)])
    probe = Linear([f"x{k}" for k in range(16)], 1.0).fit(x.filter("vec_id % 5 <> 0"))
    return probe.predict(x.filter("vec_id % 5 = 0")).agg(*errors())


@query("agg24_vector_mean", "WITH x AS (SELECT label, unnest(range(0, 64)) AS i, unnest(embedding) AS v FROM embeddings) SELECT label, CAST(i AS INT) AS i, round(avg(v), 5) AS m FROM x GROUP BY 1, 2")
def agg24(spark, sf):
    m = sx.vector_mean(table(spark, sf, "embeddings").withColumn("embedding", F.col("embedding").cast("array<double>")), ["label"], "embedding")
    return rounded(m.select("label", F.posexplode("embedding").alias("i", "m")), "m", digits=5)


@query("agg25_moments", "SELECT count(*) AS n, round(avg(embedding[1]), 5) AS mean0, round(var_pop(embedding[1]), 5) AS var0 FROM embeddings")
def agg25(spark, sf):
    n, mean, cov = sx.moments(table(spark, sf, "embeddings"), "embedding")
    return spark.createDataFrame([(n, round(float(mean[0]), 5), round(float(cov[0, 0]), 5))], "n long, mean0 double, var0 double")


@query("jon14_cells_in_boxes", f"WITH {CELLS}, {BOX_SQL}, g AS (SELECT DISTINCT row, col, lat, lon FROM c) SELECT box, count(*) AS cells FROM g JOIN b ON lat BETWEEN lat_min AND lat_max AND lon BETWEEN lon_min AND lon_max GROUP BY 1")
def jon14(spark, sf):
    cells = _cells(spark, sf).select("row", "col", "lat", "lon").distinct()
    return sx.cells_in_boxes(cells, _boxes(spark)).groupBy("box").agg(F.count(F.lit(1)).alias("cells"))


@query("jon15_nearest_cell", "WITH p AS (SELECT n_nationkey AS id, 40 + n_nationkey * 0.23 AS lat FROM nation), a AS (SELECT unnest(range(0, 12)) AS index, unnest(range(0, 12)) * 0.5 + 40 AS value) SELECT id, CAST(arg_min(index, abs(lat - value) * 1000000 + index) AS INT) AS row FROM p, a GROUP BY 1")
def jon15(spark, sf):
    points = table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), (40 + F.col("n_nationkey") * 0.23).alias("lat"))
    axis = spark.range(12).select(F.col("id").cast("int").alias("index"), (F.col("id") * 0.5 + 40).alias("value"))
    return sx.nearest_index(points, axis, "lat", "row").select("id", "row")


@query("qc1_step_counts", f"WITH {H}, s AS (SELECT date_diff('second', lag(ts) OVER (PARTITION BY zone ORDER BY ts), ts) AS step_s FROM h) SELECT step_s, count(*) AS n FROM s WHERE step_s IS NOT NULL GROUP BY 1")
def qc1(spark, sf):
    return qc.step_counts(hourly(spark, sf), ["zone"])


@query("qc2_coverage", "SELECT event_type, count(*) AS rows, min(ts) AS first, max(ts) AS last, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY 1")
def qc2(spark, sf):
    return qc.coverage(table(spark, sf, "events"), ["event_type"])


@query("qc3_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def qc3(spark, sf):
    return qc.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("qc4_conflicts", "SELECT l_orderkey, l_linenumber, round(max(l_discount) - min(l_discount), 6) AS spread FROM lineitem GROUP BY 1, 2 HAVING max(l_discount) - min(l_discount) > 0.005")
def qc4(spark, sf):
    return rounded(qc.conflicting(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], "l_discount", 0.005), "spread")


@query("qc5_null_share", "SELECT 'value' AS column_name, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS null_share FROM events UNION ALL SELECT 'props', avg(CASE WHEN props IS NULL THEN 1.0 ELSE 0.0 END) FROM events")
def qc5(spark, sf):
    return qc.null_share(table(spark, sf, "events"), ["value", "props"])


@query("qc6_missing_hours", f"WITH {H}, x AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31 23:00:00', INTERVAL 1 HOUR)) AS ts), z AS (SELECT DISTINCT zone FROM h) SELECT z.zone, x.ts FROM x, z WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.zone = z.zone AND h.ts = x.ts)")
def qc6(spark, sf):
    h = hourly(spark, sf)
    axis = src.time_axis(spark, "2024-01-01 00:00:00", "2024-01-31 23:00:00", "1 hour")
    expected = h.select("zone").distinct().withColumn("k", F.lit(1)).join(F.broadcast(axis.withColumn("k", F.lit(1))), "k").drop("k")  # zones times a fixed calendar
    return qc.missing(expected, h, ["zone", "ts"])


@query("qc7_unmatched", "WITH l AS (SELECT user_id, ts, event_id, event_type FROM events), m AS (SELECT l.event_type, l.event_id FROM l WHERE EXISTS (SELECT 1 FROM events r WHERE r.event_type = 'purchase' AND r.user_id = l.user_id AND abs(date_diff('microsecond', r.ts, l.ts)) <= 5400000000)) SELECT event_type, count(*) AS unmatched FROM l WHERE event_id NOT IN (SELECT event_id FROM m) GROUP BY 1")
def qc7(spark, sf):
    from ..operators.temporal import nearest_asof

    e = table(spark, sf, "events")
    r = e.filter("event_type = 'purchase'").select("user_id", "ts")
    j = nearest_asof(e.select("user_id", "ts", "event_id", "event_type"), r, ["user_id"], [], 5400)
    return j.filter("right_ts is null").groupBy("event_type").agg(F.count(F.lit(1)).alias("unmatched"))


@query("qc8_reconcile", "WITH p AS (SELECT l_orderkey AS o_orderkey, sum(l_extendedprice * (1 - l_discount)) AS parts FROM lineitem GROUP BY 1) SELECT o_orderkey, round((parts - o_totalprice) / o_totalprice, 6) AS gap FROM p JOIN orders USING (o_orderkey) WHERE abs(parts - o_totalprice) > 1000")
def qc8(spark, sf):
    parts = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    whole = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    return rounded(qc.reconcile(parts, whole, ["o_orderkey"], "v", 1000.0).select("o_orderkey", ((F.col("parts") - F.col("whole")) / F.col("whole")).alias("gap")), "gap")


@query("qc9_resample", f"WITH {H}, q AS (SELECT event_type AS zone, time_bucket(INTERVAL 5 MINUTE, ts) AS t, sum(value) AS s, count(*) AS n FROM events GROUP BY 1, 2), r AS (SELECT zone, date_trunc('hour', t) AS ts, sum(s) / sum(n) AS y FROM q GROUP BY 1, 2) SELECT h.zone, count(*) AS hours, CAST(sum(CASE WHEN abs(h.y - r.y) < 0.000001 THEN 1 ELSE 0 END) AS BIGINT) AS same FROM h JOIN r ON h.zone = r.zone AND h.ts = r.ts GROUP BY 1")
def qc9(spark, sf):
    e = table(spark, sf, "events")
    five = e.groupBy(F.col("event_type").alias("zone"), F.window("ts", "5 minutes").getField("start").alias("t")).agg(F.sum("value").alias("s"), F.count(F.lit(1)).alias("n"))
    r = five.groupBy("zone", F.date_trunc("hour", "t").cast("timestamp_ntz").alias("ts")).agg((F.sum("s") / F.sum("n")).alias("r"))
    j = hourly(spark, sf).join(r, ["zone", "ts"])
    return j.groupBy("zone").agg(F.count(F.lit(1)).alias("hours"), F.count_if(F.abs(F.col("y") - F.col("r")) < 1e-6).alias("same"))


EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(spark, sf):
    from ..streaming.windows import read_events

    return read_events(spark, sf, EVENT_SCHEMA, "events.parquet")


@query("stream_windowed_means", "SELECT time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '2000-01-01') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    from ..streaming.windows import drain, windowed_means

    out = drain(windowed_means(_stream(spark, sf)), folder(spark), folder(spark), "complete")
    return rounded(out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "mean"), "mean")


@query("stream_deduplicated", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def stream_dedup(spark, sf):
    from ..streaming.windows import drain, first_of_each

    out = drain(first_of_each(_stream(spark, sf)).select("event_type", "event_id"), folder(spark), folder(spark))
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_enriched", "SELECT e.event_id, n_name FROM events e JOIN nation ON n_nationkey = e.user_id % 25")
def stream_enrich(spark, sf):
    from ..streaming.windows import drain, enriched

    s = _stream(spark, sf).withColumn("n_nationkey", (F.col("user_id") % 25).cast("int"))
    return drain(enriched(s, table(spark, sf, "nation"), "n_nationkey").select("event_id", "n_name"), folder(spark), folder(spark))


@query("stream_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN date_diff('microsecond', lag(ts) OVER w, ts) < 1800000000 THEN 0 ELSE 1 END AS starts FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(starts) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS \"end\", count(*) AS n FROM s GROUP BY user_id, k")
def stream_sessions(spark, sf):
    from ..streaming.windows import drain, sessions

    out = drain(sessions(_stream(spark, sf)), folder(spark), folder(spark), "complete")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")
