"""Queries: projections, time, joins, aggregates, windows, order, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..functions import timeaxis as tx
from ..operators import panel as pn
from ..operators import qc
from ..operators import temporal as tj
from ..sources.tables import table
from .common import D, H, M, P, daily, hourly, prediction_log, rounded, split_panel
from .registry import query

ZONES = ["click", "error", "purchase", "signup", "view"]


# ---- projections -------------------------------------------------------------------------


@query("prj1_select_rename", "SELECT event_id AS id, event_type AS zone, value AS amount FROM events")
def prj1(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("zone"), F.col("value").alias("amount"))


@query("prj2_prefix_columns", "SELECT * FROM (SELECT COLUMNS('^o_order.*') FROM orders)")
def prj2(spark, sf):
    return sc.starting(table(spark, sf, "orders"), "o_order")


@query("prj3_own_zone", "WITH n AS (SELECT n_nationkey, n_name, CAST(n_nationkey * 10 AS DOUBLE) AS A_v, CAST(n_nationkey * 100 AS DOUBLE) AS B_v, CASE WHEN n_nationkey % 2 = 0 THEN 'A' ELSE 'B' END AS zone FROM nation) SELECT n_nationkey, zone, CASE zone WHEN 'A' THEN A_v WHEN 'B' THEN B_v END AS v FROM n")
def prj3(spark, sf):
    n = table(spark, sf, "nation")
    wide = n.select("n_nationkey", (F.col("n_nationkey") * 10).cast("double").alias("A_v"), (F.col("n_nationkey") * 100).cast("double").alias("B_v"), F.when(F.col("n_nationkey") % 2 == 0, "A").otherwise("B").alias("zone"))
    return sc.own_zone(wide, "n_nationkey", "zone", ["A", "B"], "v").select("n_nationkey", "zone", "v")


@query("prj4_filters", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1996-12-31' AND o_totalprice IS NOT NULL")
def prj4(spark, sf):
    o = table(spark, sf, "orders")
    d = F.col("o_orderdate")
    return o.filter(F.col("o_orderstatus").isin("F", "O") & (d >= F.lit("1996-01-01").cast("timestamp_ntz")) & (d <= F.lit("1996-12-31").cast("timestamp_ntz")) & F.col("o_totalprice").isNotNull()).select("o_orderkey", "o_totalprice")


LAGS = H + ", g AS (SELECT a.zone, a.ts, a.y, b.y AS l24, c.y AS l168 FROM h a LEFT JOIN h b ON a.zone = b.zone AND b.ts = a.ts - INTERVAL 24 HOUR LEFT JOIN h c ON a.zone = c.zone AND c.ts = a.ts - INTERVAL 168 HOUR)"


def _lags(spark, sf):
    return tj.exact_lag(hourly(spark, sf), ["zone"], "y", {"l24": 86400, "l168": 7 * 86400})


@query("prj5_common_rows", f"WITH {LAGS} SELECT zone, count(*) AS n, round(sum(y), 4) AS y FROM g WHERE y IS NOT NULL AND l24 IS NOT NULL AND l168 IS NOT NULL GROUP BY 1")
def prj5(spark, sf):
    return _lags(spark, sf).filter(sc.usable(["y", "l24", "l168"])).groupBy("zone").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("y"), 4).alias("y"))


@query("prj6_priority_case", "SELECT CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_orderpriority = '1-URGENT' THEN 'urgent' ELSE 'other' END AS label, count(*) AS n FROM orders GROUP BY 1")
def prj6(spark, sf):
    label = sc.prioritised([(F.col("o_totalprice") > 300000, "large"), (F.col("o_orderpriority") == "1-URGENT", "urgent")], "other")
    return table(spark, sf, "orders").groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("prj7_cap_by_date", "SELECT CAST(CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 9000 ELSE 5000 END AS INT) AS cap, count(*) AS n FROM orders GROUP BY 1")
def prj7(spark, sf):
    cap = F.when(F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp_ntz"), 9000).otherwise(5000)
    return table(spark, sf, "orders").groupBy(cap.alias("cap")).agg(F.count(F.lit(1)).alias("n"))


@query("prj8_concat_label", "SELECT concat_ws(' + ', 'calendar', o_orderpriority, o_orderstatus) AS label, count(*) AS n FROM orders GROUP BY 1")
def prj8(spark, sf):
    return table(spark, sf, "orders").groupBy(F.concat_ws(" + ", F.lit("calendar"), "o_orderpriority", "o_orderstatus").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("prj9_parse_label", "SELECT CAST(regexp_extract(o_orderpriority, '^(\\d+)-(.+)$', 1) AS INT) AS rank, regexp_extract(o_orderpriority, '^(\\d+)-(.+)$', 2) AS word, count(*) AS n FROM orders GROUP BY 1, 2")
def prj9(spark, sf):
    part = lambda k: F.regexp_extract("o_orderpriority", r"^(\d+)-(.+)$", k)
    return table(spark, sf, "orders").groupBy(part(1).cast("int").alias("rank"), part(2).alias("word")).agg(F.count(F.lit(1)).alias("n"))


@query("prj10_interval_text", "SELECT n_nationkey, printf('[%+.2f, %+.2f]', n_nationkey * 0.5 - 3.0, n_nationkey * 1.25) AS ci, trim(replace(n_name, '_', ' ')) AS name FROM nation")
def prj10(spark, sf):
    n = table(spark, sf, "nation")
    return n.select("n_nationkey", sc.interval_label(F.col("n_nationkey") * 0.5 - 3.0, F.col("n_nationkey") * 1.25).alias("ci"), F.trim(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("name"))


@query("prj11_dictionary", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def prj11(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey, "left")
    hit = F.when(F.col("r_name").isNull(), F.raise_error(F.lit("unknown region")).cast("string")).otherwise(F.col("r_name"))
    return j.select("n_name", hit.alias("r_name"))


@query("prj12_tolerant_cast", "SELECT TRY_CAST(replace(regexp_extract(props, '[0-9]+'), '7', 'x') AS DOUBLE) AS k, count(*) AS n FROM events GROUP BY 1")
def prj12(spark, sf):
    k = F.replace(F.regexp_extract("props", "[0-9]+", 0), F.lit("7"), F.lit("x")).try_cast("double")
    return table(spark, sf, "events").groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("prj13_numeric", "SELECT event_id, least(greatest(value, 1), 50) AS clipped, abs(value - 20) AS distance, CAST(sign(value - 20) AS INT) AS side, round(sqrt(value), 6) AS root, round(sqrt(value * value + 9), 6) AS speed FROM events")
def prj13(spark, sf):
    v = F.col("value")
    return rounded(table(spark, sf, "events").select("event_id", sc.clip(v, 1, 50).alias("clipped"), F.abs(v - 20).alias("distance"), F.signum(v - 20).cast("int").alias("side"), F.sqrt(v).alias("root"), sc.wind_speed(v, F.lit(3.0)).alias("speed")), "root", "speed")


@query("prj14_cyclic", "SELECT DISTINCT CAST(hour(ts) AS INT) AS hr, round(sin(2 * pi() * hour(ts) / 24), 6) AS s, round(cos(2 * pi() * hour(ts) / 24), 6) AS c FROM events")
def prj14(spark, sf):
    s, c = sc.cyclic(F.hour("ts"), 24)
    return table(spark, sf, "events").select(F.hour("ts").alias("hr"), (F.round(s, 6) + 0.0).alias("s"), (F.round(c, 6) + 0.0).alias("c")).distinct()


SUN = """, g AS (SELECT DISTINCT ts, 2 * pi() / 365 * (dayofyear(ts) - 1 + (hour(ts) + 0.5 - 12) / 24) AS g FROM h),
s AS (SELECT ts, 0.006918 - 0.399912 * cos(g) + 0.070257 * sin(g) - 0.006758 * cos(2 * g) + 0.000907 * sin(2 * g) - 0.002697 * cos(3 * g) + 0.00148 * sin(3 * g) AS d,
229.18 * (0.000075 + 0.001868 * cos(g) - 0.032077 * sin(g) - 0.014615 * cos(2 * g) - 0.040849 * sin(2 * g)) AS e FROM g)
SELECT ts, round(greatest(sin(radians(42.0)) * sin(d) + cos(radians(42.0)) * cos(d) * cos(radians((((hour(ts) + 0.5) * 60 + minute(ts) + e + 4 * -71.0) / 4 - 180))), 0), 6) AS cz FROM s"""


@query("prj15_cos_zenith", f"WITH {H}{SUN}")
def prj15(spark, sf):
    return rounded(hourly(spark, sf).select("ts").distinct().select("ts", sc.cos_zenith(F.col("ts"), 42.0, -71.0).alias("cz")), "cz")


@query("prj16_one_hot", f"WITH {H} SELECT zone, ts, {', '.join(f'CAST(isodow(ts) - 1 = {k} AS INT) AS dow_{k}' for k in range(7))} FROM h")
def prj16(spark, sf):
    return hourly(spark, sf).withColumn("dow", F.weekday("ts")).select("zone", "ts", *sc.one_hot("dow", list(range(7))))


@query("prj17_normalised_target", "SELECT l_orderkey, l_linenumber, round(l_extendedprice / nullif(l_quantity, 0), 9) AS unit, round(l_extendedprice / nullif(l_quantity, 0) * l_quantity, 9) AS back FROM lineitem")
def prj17(spark, sf):
    li = table(spark, sf, "lineitem")
    u = F.try_divide("l_extendedprice", "l_quantity")
    return rounded(li.select("l_orderkey", "l_linenumber", u.alias("unit"), (u * F.col("l_quantity")).alias("back")), "unit", "back", digits=9)


@query("prj18_fill_and_check", "SELECT event_id, coalesce(CASE WHEN value > 50 THEN NULL ELSE value END, 50.0) AS value FROM events")
def prj18(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.when(F.col("value") > 50, F.lit(None)).otherwise(F.col("value")).alias("value"))
    return sc.check_filled(e, {"value": 50.0})


@query("prj19_linear_rescale", f"WITH {H}, c AS (SELECT zone, regr_slope(y * 2 + 3, y) AS s, regr_intercept(y * 2 + 3, y) AS i, corr(y * 2 + 3, y) AS r FROM h GROUP BY 1) SELECT h.zone, ts, round(s * y + i, 4) AS physical FROM h JOIN c ON h.zone = c.zone WHERE r >= 0.9999")
def prj19(spark, sf):
    h = hourly(spark, sf).withColumn("t", F.col("y") * 2 + 3)
    c = h.groupBy("zone").agg(F.regr_slope("t", "y").alias("s"), F.regr_intercept("t", "y").alias("i"), F.corr("t", "y").alias("r")).filter("r >= 0.9999")
    return rounded(h.join(c, "zone").select("zone", "ts", (F.col("s") * F.col("y") + F.col("i")).alias("physical")), "physical", digits=4)


@query("prj20_differences", "SELECT l_orderkey, l_linenumber, l_quantity, round(l_tax - l_discount, 6) AS net FROM lineitem")
def prj20(spark, sf):
    return rounded(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_tax") - F.col("l_discount")).alias("net")), "net")


@query("prj21_longitude_wrap", "SELECT n_nationkey, CAST(((n_nationkey * 30.0 + 180) % 360 + 360) % 360 - 180 AS DOUBLE) AS lon FROM (SELECT n_nationkey FROM nation)")
def prj21(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", sc.wrap_longitude(F.col("n_nationkey") * F.lit(30.0)).alias("lon"))


# ---- time --------------------------------------------------------------------------------


@query("tim1_parse_offsets", "WITH p AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN ts + INTERVAL 5 HOUR WHEN 1 THEN ts - INTERVAL 330 MINUTE WHEN 2 THEN ts END AS utc FROM events) SELECT event_id, utc, (SELECT count(*) FROM p WHERE utc IS NULL) AS unreadable FROM p")
def tim1(spark, sf):
    """Offsets of several zones; what can't be read is null, and counted."""
    told = F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T"))
    raw = F.concat(told, F.element_at(F.array(F.lit("-05:00"), F.lit("+05:30"), F.lit("Z"), F.lit(" o'clock")), (F.col("event_id") % 4 + 1).cast("int")))
    e = table(spark, sf, "events").select("event_id", tx.parse_offset(raw).alias("utc"))
    return e.crossJoin(F.broadcast(e.agg(F.count_if(F.col("utc").isNull()).alias("unreadable"))))  # one row


@query("tim2_local_clock", "SELECT event_id, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS local, CAST(date_diff('second', ts, ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') / 3600.0 AS DOUBLE) AS offset_h FROM events")
def tim2(spark, sf):
    e = table(spark, sf, "events")
    local = tx.to_local(F.col("ts"), "America/New_York")
    return e.select("event_id", local.alias("local"), tx.offset_hours(local, F.col("ts")).alias("offset_h"))


@query("tim4_local_to_utc", "SELECT event_id, ts AT TIME ZONE 'America/Chicago' AT TIME ZONE 'UTC' AS utc FROM events")
def tim4(spark, sf):
    return table(spark, sf, "events").select("event_id", tx.local_to_utc(F.col("ts"), "America/Chicago", F.lit(False)).alias("utc"))


@query("tim5_hour_ending", "SELECT DISTINCT o_orderdate + INTERVAL 23 HOUR AS begins FROM orders")
def tim5(spark, sf):
    return table(spark, sf, "orders").select(tx.hour_beginning(F.col("o_orderdate"), F.lit("24:00")).alias("begins")).distinct()


@query("tim6_calendar", f"WITH {H} SELECT zone, ts, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS day_of_week, CAST(dayofyear(ts) AS INT) AS day_of_year, CAST(month(ts) AS INT) AS month, CAST(isodow(ts) >= 6 AS INT) AS is_weekend, CAST(CAST(ts AS DATE) IN ('2024-01-01', '2024-01-15') AS INT) AS is_holiday FROM h")
def tim6(spark, sf):
    return tx.calendar(hourly(spark, sf), "ts", tx.holiday_table(spark, 2023, 2025)).drop("y")


def holiday_rules() -> str:
    """SQL of the federal holidays of 1995 to 2001, each on its observed day: hd (day)."""
    nth = lambda month, weekday, n: f"make_date(y, {month}, 1) + CAST((({weekday} - isodow(make_date(y, {month}, 1)) + 7) % 7 + 7 * ({n} - 1)) AS INT)"
    fixed = lambda month, day: f"make_date(y, {month}, {day}) + CASE isodow(make_date(y, {month}, {day})) WHEN 6 THEN -1 WHEN 7 THEN 1 ELSE 0 END"
    last_monday = "make_date(y, 5, 31) - CAST(isodow(make_date(y, 5, 31)) - 1 AS INT)"
    rules = [fixed(1, 1), nth(1, 1, 3), nth(2, 1, 3), last_monday, fixed(7, 4), nth(9, 1, 1), nth(10, 1, 2), fixed(11, 11), nth(11, 4, 4), fixed(12, 25)]
    return f"hd AS (SELECT unnest([{', '.join(rules)}]) AS day FROM (SELECT unnest(range(1995, 2002)) AS y))"


@query("tim7_holidays", f"WITH {holiday_rules()} SELECT day, count(o_orderkey) AS orders FROM hd LEFT JOIN orders ON CAST(o_orderdate AS DATE) = day GROUP BY 1")
def tim7(spark, sf):
    """Orders on each holiday."""
    o = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("o_orderkey").alias("orders"))
    return tx.holiday_table(spark, 1995, 2001).join(o, "day", "left").select("day", F.coalesce("orders", F.lit(0)).cast("long").alias("orders"))


@query("tim8_bridge_days", f"WITH {holiday_rules()} SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE (isodow(o_orderdate) = 5 AND CAST(o_orderdate AS DATE) - 1 IN (SELECT day FROM hd)) OR (isodow(o_orderdate) = 1 AND CAST(o_orderdate AS DATE) + 1 IN (SELECT day FROM hd))")
def tim8(spark, sf):
    """Days between a holiday and a weekend on which something was ordered."""
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    holidays = tx.holiday_table(spark, 1995, 2001)
    near = lambda k, name: F.broadcast(holidays.select(F.date_add("day", k).alias("day"), F.lit(True).alias(name)))  # noqa: E731  some days a year
    marked = days.join(near(1, "before"), "day", "left").join(near(-1, "after"), "day", "left")
    return marked.filter(tx.bridge_day(F.col("day"), F.coalesce("before", F.lit(False)), F.coalesce("after", F.lit(False)))).select("day")


@query("tim9_date_arithmetic", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) - 1 AS d1, CAST(o_orderdate AS DATE) - 2 AS d2 FROM orders")
def tim9(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(d.alias("d"), F.date_sub(d, 1).alias("d1"), F.date_sub(d, 2).alias("d2")).distinct()


@query("tim10_round_3h", f"WITH {H} SELECT zone, ts, time_bucket(INTERVAL 3 HOUR, ts + INTERVAL 90 MINUTE, TIMESTAMP '2000-01-01') AS grid FROM h")
def tim10(spark, sf):
    return hourly(spark, sf).select("zone", "ts", tx.round_to(F.col("ts"), 3).alias("grid"))


@query("tim11_issue_time", f"WITH {H} SELECT zone, ts, ts - INTERVAL 24 HOUR AS issued FROM h")
def tim11(spark, sf):
    return hourly(spark, sf).select("zone", "ts", tx.shift(F.col("ts"), -86400).alias("issued"))


@query("tim12_iso_week", "SELECT concat(CAST(isoyear(o_orderdate) AS VARCHAR), '-', CAST(week(o_orderdate) AS VARCHAR)) AS week, count(*) AS n FROM orders GROUP BY 1")
def tim12(spark, sf):
    return table(spark, sf, "orders").groupBy(tx.iso_week(F.col("o_orderdate")).alias("week")).agg(F.count(F.lit(1)).alias("n"))


@query("tim14_previous_weekday", "SELECT DISTINCT CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) - CAST((isodow(o_orderdate) - 1 - 2 - 1 + 7) % 7 + 1 AS INT) AS wednesday FROM orders")
def tim14(spark, sf):
    d = F.to_date("o_orderdate")
    return table(spark, sf, "orders").select(d.alias("d"), tx.previous_weekday(d, 2).alias("wednesday")).distinct()


@query("tim15_days_to_quote", "WITH q AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 400000), x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT x.d, min(abs(date_diff('day', x.d, q.d))) AS days FROM x, q GROUP BY 1 HAVING min(abs(date_diff('day', x.d, q.d))) <= 30")
def tim15(spark, sf):
    o = table(spark, sf, "orders").select(F.lit("all").alias("k"), F.col("o_orderdate").alias("ts"), "o_orderpriority", "o_totalprice")
    q = o.filter("o_orderpriority = '1-URGENT' and o_totalprice > 400000").select("k", "ts").distinct()
    near = tj.nearest_asof(o.select("k", "ts").distinct(), q, ["k"], [], 30 * 86400)
    return near.dropna(subset=["right_ts"]).select(F.to_date("ts").alias("d"), F.abs(F.datediff("right_ts", "ts")).cast("long").alias("days"))


@query("tim16_centred_mean", f"WITH {H} SELECT a.zone, a.ts, round((CASE WHEN b.y IS NULL THEN a.y ELSE (a.y + b.y) / 2 END), 9) AS c FROM h a LEFT JOIN h b ON a.zone = b.zone AND b.ts = a.ts - INTERVAL 1 HOUR")
def tim16(spark, sf):
    h = tj.exact_lag(hourly(spark, sf), ["zone"], "y", {"before": 3600})
    return rounded(h.select("zone", "ts", F.when(F.col("before").isNull(), F.col("y")).otherwise((F.col("y") + F.col("before")) / 2).alias("c")), "c", digits=9)


@query("tim17_on_the_hour", f"WITH {H} SELECT zone, ts FROM h WHERE hour(ts) % 3 = 0")
def tim17(spark, sf):
    """Every third hour of stamps that are all on the hour; another minute stops the query."""
    return tx.on_the_hour(hourly(spark, sf).select("zone", "ts"), "ts").filter(F.hour("ts") % 3 == 0)


@query("tim18_monthly_static", "WITH s AS (SELECT CAST(month(o_orderdate) AS INT) AS m, avg(o_totalprice) AS norm FROM orders GROUP BY 1) SELECT o_orderkey, round(o_totalprice - norm, 4) AS anomaly FROM orders JOIN s ON month(o_orderdate) = m")
def tim18(spark, sf):
    o = table(spark, sf, "orders").withColumn("m", F.month("o_orderdate"))
    s = o.groupBy("m").agg(F.avg("o_totalprice").alias("norm"))  # twelve rows
    return rounded(o.join(F.broadcast(s), "m").select("o_orderkey", (F.col("o_totalprice") - F.col("norm")).alias("anomaly")), "anomaly", digits=4)


# ---- joins -------------------------------------------------------------------------------


@query("jon1_inner", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def jon1(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name")


@query("jon2_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
def jon2(spark, sf):
    o, c = table(spark, sf, "orders").filter("o_totalprice > 400000"), table(spark, sf, "customer")
    return c.join(o, o.o_custkey == c.c_custkey, "left").select("c_custkey", "o_orderkey")


@query("jon3_index_join", f"WITH {H} SELECT a.ts, round(a.y - b.y, 6) AS spread FROM h a JOIN h b ON a.ts = b.ts WHERE a.zone = 'click' AND b.zone = 'view'")
def jon3(spark, sf):
    h = hourly(spark, sf)
    a, b = h.filter("zone = 'click'").select("ts", F.col("y").alias("a")), h.filter("zone = 'view'").select("ts", F.col("y").alias("b"))
    return rounded(a.join(b, "ts").select("ts", (F.col("a") - F.col("b")).alias("spread")), "spread")


def _sides(spark, sf):
    e = table(spark, sf, "events")
    return e.filter("event_type = 'click'").select("user_id", "ts", "event_id"), e.filter("event_type = 'purchase'").select("user_id", "ts", "value")


ASOF = "l AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click'), r AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase'), b AS (SELECT l.*, r.ts AS bt, r.value AS bv FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts), f AS (SELECT l.event_id, r.ts AS ft, r.value AS fv FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts <= r.ts)"


@query("jon4_nearest_asof", f"WITH {ASOF}, x AS (SELECT b.event_id, b.ts, CASE WHEN bt IS NOT NULL AND (ft IS NULL OR b.ts - bt <= ft - b.ts) THEN bt ELSE ft END AS t, CASE WHEN bt IS NOT NULL AND (ft IS NULL OR b.ts - bt <= ft - b.ts) THEN bv ELSE fv END AS v FROM b JOIN f ON b.event_id = f.event_id) SELECT event_id, CASE WHEN abs(date_diff('microsecond', ts, t)) <= 21600000000 THEN t END AS right_ts, CASE WHEN abs(date_diff('microsecond', ts, t)) <= 21600000000 THEN v END AS value FROM x")
def jon4(spark, sf):
    left, right = _sides(spark, sf)
    return tj.nearest_asof(left, right, ["user_id"], ["value"], 6 * 3600).select("event_id", "right_ts", "value")


@query("jon5_rounded_key", f"WITH {H}, g AS (SELECT zone, ts AS grid, y AS w FROM h WHERE hour(ts) % 3 = 0) SELECT h.zone, h.ts, round(g.w, 6) AS w FROM h JOIN g ON h.zone = g.zone AND g.grid = time_bucket(INTERVAL 3 HOUR, h.ts + INTERVAL 90 MINUTE, TIMESTAMP '2000-01-01')")
def jon5(spark, sf):
    h = hourly(spark, sf)
    g = h.filter(F.hour("ts") % 3 == 0).select("zone", F.col("ts").alias("grid"), F.col("y").alias("w"))
    return rounded(h.withColumn("grid", tx.round_to(F.col("ts"), 3)).join(g, ["zone", "grid"]).select("zone", "ts", "w"), "w")


@query("jon6_backward_asof", f"WITH {ASOF} SELECT event_id, bt AS right_ts, bv AS value FROM b")
def jon6(spark, sf):
    left, right = _sides(spark, sf)
    return tj.backward_asof(left, right, ["user_id"], ["value"], bucket_s=7 * 86400).select("event_id", "right_ts", "value")


@query("jon7_exact_lag", f"WITH {LAGS} SELECT zone, ts, round(l24, 6) AS l24, round(l168, 6) AS l168 FROM g")
def jon7(spark, sf):
    return rounded(_lags(spark, sf).drop("y"), "l24", "l168")


@query("jon8_row_shift", f"WITH {H} SELECT zone, ts, round(y - lag(y, 3) OVER (PARTITION BY zone ORDER BY ts), 6) AS ramp FROM h")
def jon8(spark, sf):
    w = Window.partitionBy("zone").orderBy("ts")
    return rounded(hourly(spark, sf).select("zone", "ts", (F.col("y") - F.lag("y", 3).over(w)).alias("ramp")), "ramp")


VERSIONS = "v AS (SELECT l_partkey AS part, l_shipdate AS target, o_orderdate AS created, l_extendedprice AS forecast, l_orderkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query("jon9_latest_known", f"WITH {VERSIONS} SELECT part, target, round(max(forecast), 4) AS forecast, max(created) AS created FROM (SELECT *, rank() OVER (PARTITION BY part, target ORDER BY created DESC) AS k FROM v WHERE created <= target - INTERVAL 10 DAY) WHERE k = 1 GROUP BY 1, 2")
def jon9(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders")
    v = li.join(o, li.l_orderkey == o.o_orderkey).select(F.col("l_partkey").alias("part"), F.col("l_shipdate").alias("target"), F.col("o_orderdate").alias("created"), F.col("l_extendedprice").alias("forecast"))
    return rounded(tj.latest_known(v, ["part", "target"], "forecast", "created", F.col("created") <= tx.shift(F.col("target"), -10 * 86400)), "forecast", digits=4)


@query("jon10_preferred_lead", "SELECT l_orderkey, max(l_quantity) AS l_quantity, max(l_linenumber) AS l_linenumber FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS k FROM lineitem WHERE l_linenumber IN (2, 3) AND l_quantity IS NOT NULL) WHERE k = 1 GROUP BY 1")
def jon10(spark, sf):
    return tj.preferred(table(spark, sf, "lineitem"), ["l_orderkey"], "l_quantity", "l_linenumber", [2, 3])


@query("jon11_computed_lead", f"WITH {H}, x AS (SELECT zone, ts, CAST(round_even(hour(ts) / 3.0, 0) * 3 AS INT) AS lead FROM h) SELECT x.zone, x.ts, x.lead, round(h.y, 6) AS y FROM x JOIN h ON x.zone = h.zone AND h.ts = x.ts - to_hours(x.lead)")
def jon11(spark, sf):
    h = hourly(spark, sf)
    x = h.select("zone", "ts", (F.bround(F.hour("ts") / 3.0, 0) * 3).cast("int").alias("lead")).withColumn("issue", F.timestamp_add("HOUR", -F.col("lead"), F.col("ts")))
    return rounded(x.join(h.select("zone", F.col("ts").alias("issue"), "y"), ["zone", "issue"]).select("zone", "ts", "lead", "y"), "y")


@query("jon12_placebo", f"WITH {H} SELECT a.zone, a.ts, round(coalesce(b.y, c.y, a.y), 6) AS placebo FROM h a LEFT JOIN h b ON a.zone = b.zone AND b.ts = a.ts + INTERVAL 7 DAY LEFT JOIN h c ON a.zone = c.zone AND c.ts = a.ts - INTERVAL 7 DAY")
def jon12(spark, sf):
    return rounded(tj.placebo(hourly(spark, sf), ["zone"], "y", 7 * 86400).select("zone", "ts", "placebo"), "placebo")


@query("jon13_permutation", "WITH o AS (SELECT o_orderkey, year(o_orderdate) AS yr, o_totalprice AS v, row_number() OVER (PARTITION BY year(o_orderdate), o_orderstatus ORDER BY o_orderkey) AS n, row_number() OVER (PARTITION BY year(o_orderdate), o_orderstatus ORDER BY md5(concat('5|', CAST(o_orderkey AS VARCHAR))), o_orderkey) AS m, o_orderstatus AS s FROM orders) SELECT a.o_orderkey, b.v AS placebo FROM o a JOIN o b ON a.yr = b.yr AND a.s = b.s AND a.n = b.m")
def jon13(spark, sf):
    o = table(spark, sf, "orders").withColumn("yr", F.year("o_orderdate"))
    return tj.permuted(o, ["yr", "o_orderstatus"], "o_orderkey", "o_totalprice", 5).select("o_orderkey", "placebo")


@query("jon16_region_to_zones", f"WITH {H}, r AS (SELECT ts, avg(y) AS regional FROM h GROUP BY 1) SELECT h.zone, h.ts, round(r.regional, 6) AS regional FROM h JOIN r ON h.ts = r.ts")
def jon16(spark, sf):
    h = hourly(spark, sf)
    return rounded(h.select("zone", "ts").join(h.groupBy("ts").agg(F.avg("y").alias("regional")), "ts").select("zone", "ts", "regional"), "regional")


@query("jon17_semi", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def jon17(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'")
    return o.join(c, o.o_custkey == c.c_custkey, "left_semi").select("o_orderkey")


@query("jon18_buffer_anti", "WITH x AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT day FROM x WHERE NOT EXISTS (SELECT 1 FROM (SELECT day AS held FROM x WHERE day(day) = 15) t WHERE abs(date_diff('day', t.held, x.day)) <= 3)")
def jon18(spark, sf):
    days = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.join(tj.near_days(days.filter(F.day("day") == 15), 3), "day", "left_anti")


@query("jon19_division", "SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = (SELECT count(DISTINCT event_type) FROM events)")
def jon19(spark, sf):
    e = table(spark, sf, "events")
    kinds = e.agg(F.countDistinct("event_type").alias("k"))
    return e.groupBy("user_id").agg(F.countDistinct("event_type").alias("n")).join(F.broadcast(kinds), F.col("n") == F.col("k")).select("user_id")


@query("jon20_pair_contrast", f"WITH {M} SELECT a.zone, a.ts, round(abs(a.yhat - a.y) - abs(b.yhat - b.y), 5) AS d FROM log a JOIN log b ON a.zone = b.zone AND a.ts = b.ts AND a.feature_set = 'climatology' AND b.feature_set = 'mean'")
def jon20(spark, sf):
    from ..operators.evaluate import paired

    return rounded(paired(prediction_log(spark, sf), ["zone", "ts"], ("climatology", "mean")).select("zone", "ts", "d"), "d", digits=5)


@query("jon21_day_labels", f"WITH {H}, d AS (SELECT zone, CAST(ts AS DATE) AS day, max(y) > 20 AS big FROM h GROUP BY 1, 2) SELECT h.zone, h.ts, d.big FROM h LEFT JOIN d ON h.zone = d.zone AND CAST(h.ts AS DATE) = d.day")
def jon21(spark, sf):
    h = hourly(spark, sf).withColumn("day", F.to_date("ts"))
    return h.join(h.groupBy("zone", "day").agg((F.max("y") > 20).alias("big")), ["zone", "day"], "left").select("zone", "ts", "big")


@query("jon27_interval_overlap", "WITH i AS (SELECT o_custkey AS customer, o_orderkey AS k, o_orderdate AS s, o_orderdate + to_days(CAST(10 + o_orderkey % 40 AS INT)) AS e FROM orders) SELECT a.customer, a.k AS first, b.k AS second, CAST(date_diff('day', greatest(a.s, b.s), least(a.e, b.e)) AS BIGINT) AS days FROM i a JOIN i b ON a.customer = b.customer AND a.k < b.k AND a.s < b.e AND b.s < a.e")
def jon27(spark, sf):
    """Orders of one customer that are open at the same time."""
    start, length = F.col("o_orderdate").cast("timestamp_ntz"), (10 + F.col("o_orderkey") % 40).cast("int")
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("k"), start.alias("s"), F.timestamp_add("DAY", length, start).alias("e"))
    other = o.select("customer", F.col("k").alias("k2"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    pairs = tj.interval_join(o, other, ["customer"], ("s", "e"), ("s2", "e2"), 30 * 86400).filter("k < k2")
    days = F.timestamp_diff("DAY", F.greatest("s", "s2"), F.least("e", "e2"))
    return pairs.select("customer", F.col("k").alias("first"), F.col("k2").alias("second"), days.cast("long").alias("days"))


@query("jon28_full_outer", "WITH a AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS orders FROM orders GROUP BY 1), b AS (SELECT CAST(l_shipdate AS DATE) AS day, count(*) AS shipped FROM lineitem GROUP BY 1) SELECT coalesce(a.day, b.day) AS day, coalesce(orders, 0) AS orders, coalesce(shipped, 0) AS shipped FROM a FULL JOIN b ON a.day = b.day")
def jon28(spark, sf):
    """Days with orders, shipments or both."""
    a = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("orders"))
    b = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.count(F.lit(1)).alias("shipped"))
    return a.join(b, "day", "full").select("day", F.coalesce("orders", F.lit(0)).cast("long").alias("orders"), F.coalesce("shipped", F.lit(0)).cast("long").alias("shipped"))


@query("agg27_cube", "SELECT o_orderstatus, year(o_orderdate) AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY CUBE (o_orderstatus, year(o_orderdate))")
def agg27(spark, sf):
    o = table(spark, sf, "orders").select("o_orderstatus", F.year("o_orderdate").cast("long").alias("year"), "o_totalprice")
    return o.cube("o_orderstatus", "year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("jon22_reconcile_keys", f"WITH {H}, a AS (SELECT zone, ts, y, row_number() OVER (PARTITION BY zone ORDER BY ts) AS n FROM h), b AS (SELECT zone, ts, y, row_number() OVER (PARTITION BY zone ORDER BY ts) AS n FROM h WHERE NOT (zone = 'click' AND hour(ts) = 5 AND day(ts) = 7)) SELECT coalesce(a.zone, b.zone) AS zone, count(a.n) AS rows_a, count(b.n) AS rows_b, CAST(count_if(a.ts = b.ts) AS BIGINT) AS same_place, min(CASE WHEN a.ts IS DISTINCT FROM b.ts THEN coalesce(a.n, b.n) END) AS first_off FROM a FULL JOIN b ON a.zone = b.zone AND a.n = b.n GROUP BY 1")
def jon22(spark, sf):
    """The order of rows of two runs, one of which lacks an hour: where they come apart."""
    run = hourly(spark, sf).select("zone", "ts", "y")
    other = run.filter(~((F.col("zone") == "click") & (F.hour("ts") == 5) & (F.day("ts") == 7)))
    return qc.reconcile_order(run, other, ["zone"], "ts")


@query("jon23_information_lag", f"WITH {H}, g AS (SELECT zone, ts AS grid, y AS w FROM h WHERE hour(ts) % 3 = 0) SELECT h.zone, h.ts, round(g.w, 6) AS w FROM h JOIN g ON h.zone = g.zone AND g.grid = time_bucket(INTERVAL 3 HOUR, h.ts - INTERVAL 24 HOUR + INTERVAL 90 MINUTE, TIMESTAMP '2000-01-01')")
def jon23(spark, sf):
    h = hourly(spark, sf)
    g = h.filter(F.hour("ts") % 3 == 0).select("zone", F.col("ts").alias("grid"), F.col("y").alias("w"))
    return rounded(h.withColumn("grid", tx.round_to(tx.shift(F.col("ts"), -86400), 3)).join(g, ["zone", "grid"]).select("zone", "ts", "w"), "w")


@query("jon24_lead_lags", f"WITH {H}, l AS (SELECT unnest([1, 8]) AS lead), k AS (SELECT a.zone, a.ts, lead FROM h a CROSS JOIN l) SELECT k.zone, k.ts, CAST(k.lead AS INT) AS lead, round(b.y, 6) AS lag_lead, round(c.y, 6) AS lag_next, round(d.y, 6) AS lag_week FROM k LEFT JOIN h b ON k.zone = b.zone AND b.ts = k.ts - to_days(k.lead) LEFT JOIN h c ON k.zone = c.zone AND c.ts = k.ts - to_days(k.lead + 1) LEFT JOIN h d ON k.zone = d.zone AND d.ts = k.ts - to_days(CASE WHEN k.lead <= 7 THEN 7 ELSE 14 END)")
def jon24(spark, sf):
    h = hourly(spark, sf)
    both = tj.lead_lags(h, ["zone"], "y", 1).unionByName(tj.lead_lags(h, ["zone"], "y", 8))
    return rounded(both.drop("y"), "lag_lead", "lag_next", "lag_week")


@query("jon25_conditional_availability", f"WITH {H} SELECT a.zone, a.ts, round(CASE WHEN hour(a.ts) < 10 THEN b.y END, 6) AS known FROM h a LEFT JOIN h b ON a.zone = b.zone AND b.ts = a.ts - INTERVAL 24 HOUR")
def jon25(spark, sf):
    h = tj.exact_lag(hourly(spark, sf), ["zone"], "y", {"p": 86400})
    return rounded(h.select("zone", "ts", F.when(F.hour("ts") < 10, F.col("p")).alias("known")), "known")


@query("jon26_day_extremes", f"WITH {H} SELECT zone, ts, round(avg(y) OVER w, 9) AS day_mean, max(y) OVER w AS day_max, min(y) OVER w AS day_min FROM h WINDOW w AS (PARTITION BY zone, CAST(ts AS DATE))")
def jon26(spark, sf):
    w = Window.partitionBy("zone", F.to_date("ts"))
    x = hourly(spark, sf).select("zone", "ts", F.avg("y").over(w).alias("day_mean"), F.max("y").over(w).alias("day_max"), F.min("y").over(w).alias("day_min"))
    return rounded(x, "day_mean", digits=9)


# ---- aggregates --------------------------------------------------------------------------


@query("agg1_basic", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(sum(value), 3) AS total, min(value) AS lo, max(value) AS hi, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def agg1(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.sum("value"), 3).alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.countDistinct("user_id").alias("users"))
    return g


@query("agg2_min_count_sum", f"WITH {H} SELECT ts, CASE WHEN count(y) >= 4 THEN round(sum(y), 5) END AS total FROM h GROUP BY 1")
def agg2(spark, sf):
    return rounded(hourly(spark, sf).groupBy("ts").agg(pn.sum_at_least(F.col("y"), 4).alias("total")), "total", digits=5)


@query("agg3_all_parts_sum", f"WITH {H} SELECT ts, CASE WHEN count(DISTINCT zone) = 5 THEN round(sum(y), 5) END AS total FROM h GROUP BY 1")
def agg3(spark, sf):
    return rounded(hourly(spark, sf).groupBy("ts").agg(pn.sum_if_all(F.col("y"), F.col("zone"), 5).alias("total")), "total", digits=5)


@query("agg4_first", "SELECT user_id, arg_min(value, ts) AS first_value FROM events GROUP BY 1")
def agg4(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("value", "ts").alias("first_value"))


@query("agg5_last", "SELECT user_id, arg_max(value, ts) AS last_value FROM events GROUP BY 1")
def agg5(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.max_by("value", "ts").alias("last_value"))


@query("agg6_keep_first", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS n FROM events) WHERE n = 1")
def agg6(spark, sf):
    return pn.keep_one(table(spark, sf, "events"), ["user_id", "event_type"], [F.desc("value"), F.col("event_id")]).select("user_id", "event_type", "event_id")


@query("agg7_share_weights", f"WITH {H}, w AS (SELECT zone, sum(y) / (SELECT sum(y) FROM h) AS weight FROM h GROUP BY 1) SELECT ts, round(sum(y * weight) / sum(weight), 5) AS y FROM h JOIN w ON h.zone = w.zone GROUP BY 1")
def agg7(spark, sf):
    h = hourly(spark, sf)
    return rounded(pn.weighted_mean(h, pn.share_weights(h, "zone", "y"), "zone", ["ts"], "y"), "y", digits=5)


@query("agg8_exact_quantiles", "SELECT event_type, round(quantile_cont(value, 0.05), 6) AS q05, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.95), 6) AS q95 FROM events GROUP BY 1")
def agg8(spark, sf):
    names = {"q05": 0.05, "q50": 0.5, "q95": 0.95}
    return rounded(pn.exact_quantiles(table(spark, sf, "events"), "value", ["event_type"], names), *names)


@query("agg9_filtered", f"WITH {P} SELECT zone, round(quantile_cont(y, 0.9) FILTER (WHERE split = 'train'), 6) AS q90, count(*) FILTER (WHERE split = 'test') AS n_test FROM p GROUP BY 1")
def agg9(spark, sf):
    g = split_panel(spark, sf).groupBy("zone").agg(F.percentile(F.when(F.col("split") == "train", F.col("y")), F.lit(0.9)).alias("q90"), F.count_if(F.col("split") == "test").alias("n_test"))
    return rounded(g, "q90")


@query("agg10_spread", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS med, round(stddev_samp(value), 5) AS sd1, round(stddev_pop(value), 5) AS sd0 FROM events GROUP BY 1")
def agg10(spark, sf):
    g = table(spark, sf, "events").groupBy("event_type").agg(F.percentile("value", F.lit(0.5)).alias("med"), F.stddev_samp("value").alias("sd1"), F.stddev_pop("value").alias("sd0"))
    return rounded(rounded(g, "med"), "sd1", "sd0", digits=5)


@query("agg11_correlation", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 5) AS r FROM lineitem GROUP BY 1")
def agg11(spark, sf):
    return rounded(table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.corr("l_quantity", "l_extendedprice").alias("r")), "r", digits=5)


@query("agg12_spearman", "WITH x AS (SELECT o_orderpriority AS p, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderpriority, o_totalprice) - 1) / 2.0 AS a, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) + (count(*) OVER (PARTITION BY o_orderpriority, o_orderdate) - 1) / 2.0 AS b FROM orders) SELECT p, round(corr(a, b), 5) AS rho FROM x GROUP BY 1")
def agg12(spark, sf):
    o = table(spark, sf, "orders").withColumn("p", F.col("o_orderpriority"))
    x = pn.ranked(pn.ranked(o, "o_totalprice", ["p"], "a"), "o_orderdate", ["p"], "b")
    return rounded(x.groupBy("p").agg(F.corr("a", "b").alias("rho")), "rho", digits=5)


@query("agg13_ols", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY 1")
def agg13(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.round(F.regr_slope("l_extendedprice", "l_quantity"), 3).alias("slope"), F.round(F.regr_intercept("l_extendedprice", "l_quantity"), 2).alias("intercept"))


@query("agg14_pivot", f"WITH {H} SELECT ts, " + ", ".join(f"round(max(CASE WHEN zone = '{z}' THEN y END), 6) AS {z}" for z in ZONES) + " FROM h GROUP BY 1")
def agg14(spark, sf):
    return rounded(pn.pivot_strict(hourly(spark, sf), ["ts"], "zone", "y", ZONES), *ZONES)


@query("agg15_unstack", "SELECT o_orderpriority, " + ", ".join(f"count(*) FILTER (WHERE o_orderstatus = '{s}') AS s_{s}" for s in "FOP") + " FROM orders GROUP BY 1")
def agg15(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(f"s_{s}") for s in "FOP"])


@query("agg17_describe", "SELECT count(value) AS n, round(avg(value), 6) AS mean, min(value) AS lo, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.75), 6) AS q75, max(value) AS hi FROM events")
def agg17(spark, sf):
    e = table(spark, sf, "events").select("value")
    rest = e.agg(F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    q = pn.exact_quantiles(e, "value", [], {"q25": 0.25, "q75": 0.75})
    return rounded(rest.crossJoin(F.broadcast(q)), "q25", "q75")  # one row each


@query("agg18_capped_histogram", "SELECT CAST(floor(least(value, 30.5)) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1")
def agg18(spark, sf):
    return table(spark, sf, "events").groupBy(F.floor(F.least("value", F.lit(30.5))).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("agg19_threshold_shares", "SELECT event_type, round(avg(CASE WHEN value < 5 THEN 1.0 ELSE 0.0 END), 6) AS under5, round(avg(CASE WHEN value < 20 THEN 1.0 ELSE 0.0 END), 6) AS under20 FROM events GROUP BY 1")
def agg19(spark, sf):
    s = lambda t: F.round(F.avg((F.col("value") < t).cast("double")), 6)
    return table(spark, sf, "events").groupBy("event_type").agg(s(5).alias("under5"), s(20).alias("under20"))


@query("agg20_mean_zone_r2", f"WITH {M}, z AS (SELECT feature_set, zone, 1 - sum(power(yhat - y, 2)) / (count(*) * var_pop(y)) AS r2 FROM log GROUP BY 1, 2) SELECT feature_set, round(avg(r2), 6) AS r2 FROM z GROUP BY 1")
def agg20(spark, sf):
    from ..operators.evaluate import errors

    return rounded(prediction_log(spark, sf).groupBy("feature_set", "zone").agg(*errors()).groupBy("feature_set").agg(F.avg("r2").alias("r2")), "r2")


@query("agg21_deseasonalise", f"WITH {H} SELECT zone, ts, round(y - avg(y) OVER (PARTITION BY zone, month(ts), hour(ts)), 9) AS a FROM h")
def agg21(spark, sf):
    h = hourly(spark, sf).withColumns({"m": F.month("ts"), "hr": F.hour("ts")})
    return rounded(h.select("zone", "ts", pn.deseasonalised("y", ["zone", "m", "hr"]).alias("a")), "a", digits=9)


@query("agg22_decile_composite", f"WITH {H}, q AS (SELECT zone, quantile_cont(y, 0.1) AS lo, quantile_cont(y, 0.9) AS hi FROM h GROUP BY 1) SELECT h.zone, round(avg(CASE WHEN y >= hi THEN hour(ts) END) - avg(CASE WHEN y <= lo THEN hour(ts) END), 6) AS composite FROM h JOIN q ON h.zone = q.zone GROUP BY 1")
def agg22(spark, sf):
    h = hourly(spark, sf)
    q = h.groupBy("zone").agg(F.percentile("y", F.lit(0.1)).alias("lo"), F.percentile("y", F.lit(0.9)).alias("hi"))
    hr = F.hour("ts")
    return h.join(q, "zone").groupBy("zone").agg(F.round(F.avg(F.when(F.col("y") >= F.col("hi"), hr)) - F.avg(F.when(F.col("y") <= F.col("lo"), hr)), 6).alias("composite"))


@query("agg23_bias_table", f"WITH {P}, b AS (SELECT zone, hour(ts) AS hr, avg(y - 20) AS bias FROM p WHERE split = 'train' GROUP BY 1, 2) SELECT p.zone, p.ts, round(coalesce(b.bias, 0), 6) AS bias FROM p LEFT JOIN b ON p.zone = b.zone AND hour(p.ts) = b.hr")
def agg23(spark, sf):
    p = split_panel(spark, sf).withColumn("hr", F.hour("ts"))
    b = p.filter("split = 'train'").groupBy("zone", "hr").agg(F.avg(F.col("y") - 20).alias("bias"))
    return rounded(p.join(b, ["zone", "hr"], "left").select("zone", "ts", F.coalesce("bias", F.lit(0.0)).alias("bias")), "bias")


@query("agg26_channel_skill", f"WITH {P}, c AS (SELECT zone, avg(y) AS clim FROM p WHERE split = 'train' GROUP BY 1), k AS (SELECT p.zone, 1 - sum(power(y - 20, 2)) / sum(power(y - clim, 2)) AS skill FROM p JOIN c ON p.zone = c.zone WHERE split = 'test' GROUP BY 1) SELECT round(quantile_cont(skill, 0.5), 6) AS median_skill FROM k")
def agg26(spark, sf):
    from ..operators.evaluate import skill
    from ..operators.models import training_mean

    p = training_mean(split_panel(spark, sf), ["zone"]).filter("split = 'test'")
    k = p.groupBy("zone").agg(skill((F.col("y") - 20) ** 2, (F.col("y") - F.col("yhat")) ** 2).alias("skill"))
    return k.agg(F.round(F.percentile("skill", F.lit(0.5)), 6).alias("median_skill"))


@query("agg_rollup", "SELECT event_type, CAST(hour(ts) AS INT) AS hr, count(*) AS n FROM events GROUP BY ROLLUP (event_type, CAST(hour(ts) AS INT))")
def agg_rollup(spark, sf):
    return table(spark, sf, "events").withColumn("hr", F.hour("ts")).rollup("event_type", "hr").agg(F.count(F.lit(1)).alias("n"))


# ---- windows -----------------------------------------------------------------------------


@query("win1_rolling_mean", f"WITH {H} SELECT zone, ts, round(avg(y) OVER (PARTITION BY zone ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW), 9) AS m24 FROM h")
def win1(spark, sf):
    return rounded(pn.rolling_mean(hourly(spark, sf), ["zone"], "y", 86400, "m24").drop("y"), "m24", digits=9)


@query("win2_rolling_quantile", f"WITH {H} SELECT zone, ts, CASE WHEN count(y) OVER w >= 48 THEN round(quantile_cont(y, 0.99) OVER w, 9) END AS q FROM h WINDOW w AS (PARTITION BY zone ORDER BY epoch_us(ts) RANGE BETWEEN 259199999999 PRECEDING AND CURRENT ROW)")
def win2(spark, sf):
    return rounded(pn.rolling_quantile(hourly(spark, sf), ["zone"], "y", 3 * 86400, 0.99, 48, "q").drop("y"), "q", digits=9)


@query("win3_percent_rank_average", "SELECT o_orderkey, round((rank() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate) + (count(*) OVER (PARTITION BY o_orderpriority, o_orderdate) - 1) / 2.0) / count(*) OVER (PARTITION BY o_orderpriority), 8) AS pr FROM orders")
def win3(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return rounded(pn.ranked(o, "o_orderdate", ["o_orderpriority"], "pr", percent=True).select("o_orderkey", "pr"), "pr", digits=8)


@query("win4_dense_rank", "SELECT n_nationkey, CAST(dense_rank() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS INT) AS r FROM nation")
def win4(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.dense_rank().over(Window.partitionBy("n_regionkey").orderBy("n_name")).alias("r"))


@query("win5_daily_difference", f"WITH {D} SELECT zone, CAST(ts AS DATE) AS day, round(CASE WHEN date_diff('day', lag(ts) OVER w, ts) = 1 THEN y - lag(y) OVER w END, 3) AS dy FROM d WINDOW w AS (PARTITION BY zone ORDER BY ts)")
def win5(spark, sf):
    d = daily(spark, sf).withColumn("day", F.to_date("ts"))
    return rounded(pn.daily_difference(d.select("zone", "day", "y"), ["zone"], "y", "day", "dy").select("zone", "day", "dy"), "dy", digits=3)


@query("win6_gap_lengths", f"WITH {D} SELECT zone, CAST(ts AS DATE) AS day, CAST(date_diff('day', lag(ts) OVER (PARTITION BY zone ORDER BY ts), ts) AS INT) AS gap FROM d")
def win6(spark, sf):
    w = Window.partitionBy("zone").orderBy("ts")
    return daily(spark, sf).select("zone", F.to_date("ts").alias("day"), F.datediff("ts", F.lag("ts").over(w)).alias("gap"))


@query("win8_group_mean", f"WITH {H} SELECT zone, ts, round(avg(y) OVER (PARTITION BY ts), 9) AS m FROM h")
def win8(spark, sf):
    return rounded(hourly(spark, sf).select("zone", "ts", F.avg("y").over(Window.partitionBy("ts")).alias("m")), "m", digits=9)


GAPPY = H + ", k AS (SELECT zone, ts, CASE WHEN hour(ts) % 6 = 0 THEN y END AS v, epoch_us(ts) AS m FROM h)"


def _gappy(spark, sf):
    return hourly(spark, sf).select("zone", "ts", F.when(F.hour("ts") % 6 == 0, F.col("y")).alias("v"))


@query("win9_stable_key", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS n FROM orders")
def win9(spark, sf):
    """A number for each row in a stated order, without a sort of all rows in one task."""
    return pn.numbered(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", "n").select("o_orderkey", "n")


@query("win10_interpolate", f"WITH {GAPPY}, a AS (SELECT *, last_value(v IGNORE NULLS) OVER u AS av, last_value(CASE WHEN v IS NOT NULL THEN m END IGNORE NULLS) OVER u AS am, first_value(v IGNORE NULLS) OVER n AS zv, first_value(CASE WHEN v IS NOT NULL THEN m END IGNORE NULLS) OVER n AS zm FROM k WINDOW u AS (PARTITION BY zone ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY zone ORDER BY m ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) SELECT zone, ts, round(CASE WHEN av IS NULL THEN NULL WHEN zv IS NULL OR zm = am THEN av ELSE av + (zv - av) * (m - am) / (zm - am) END, 9) AS filled FROM a")
def win10(spark, sf):
    return rounded(tj.interpolate(_gappy(spark, sf), ["zone"], "v").select("zone", "ts", "filled"), "filled", digits=9)


@query("win11_forward_fill", f"WITH {GAPPY} SELECT zone, ts, round(last_value(v IGNORE NULLS) OVER (PARTITION BY zone ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS filled FROM k")
def win11(spark, sf):
    return rounded(tj.forward_fill(_gappy(spark, sf), ["zone"], "v").select("zone", "ts", "filled"), "filled")


@query("win12_trapezoid", f"WITH {H} SELECT zone, ts, round((y + lag(y) OVER w) / 2, 9) AS two, round((lag(y, 2) OVER w / 2 + lag(y) OVER w + y / 2) / 2, 9) AS trap FROM h WINDOW w AS (PARTITION BY zone ORDER BY ts)")
def win12(spark, sf):
    w = Window.partitionBy("zone").orderBy("ts")
    y, a, b = F.col("y"), F.lag("y").over(w), F.lag("y", 2).over(w)
    return rounded(hourly(spark, sf).select("zone", "ts", ((y + a) / 2).alias("two"), ((b / 2 + a + y / 2) / 2).alias("trap")), "two", "trap", digits=9)


@query("win13_capacity_factor", f"WITH {H}, c AS (SELECT zone, ts, CASE WHEN count(y) OVER w >= 48 THEN quantile_cont(y, 0.99) OVER w END AS cap FROM h WINDOW w AS (PARTITION BY zone ORDER BY epoch_us(ts) RANGE BETWEEN 259199999999 PRECEDING AND CURRENT ROW)) SELECT h.zone, h.ts, round(h.y / nullif(c.cap, 0), 5) AS cf FROM h LEFT JOIN c ON h.zone = c.zone AND c.ts = h.ts - INTERVAL 24 HOUR")
def win13(spark, sf):
    h = hourly(spark, sf)
    cap = pn.rolling_quantile(h, ["zone"], "y", 3 * 86400, 0.99, 48, "cap").select("zone", tx.shift(F.col("ts"), 86400).alias("ts"), "cap")
    return rounded(h.join(cap, ["zone", "ts"], "left").select("zone", "ts", F.try_divide("y", "cap").alias("cf")), "cf", digits=5)


# ---- order and sets ----------------------------------------------------------------------


@query("ord1_sorted", f"WITH {H} SELECT zone, ts, round(y, 6) AS y FROM h ORDER BY zone, ts")
def ord1(spark, sf):
    return rounded(hourly(spark, sf), "y").orderBy("zone", "ts")


@query("ord2_worst_days", f"WITH {D}, r AS (SELECT *, count(*) OVER (PARTITION BY zone) AS n, row_number() OVER (PARTITION BY zone ORDER BY y DESC, ts) AS k FROM d) SELECT zone, ts FROM r WHERE k <= round_even(0.05 * n, 0)")
def ord2(spark, sf):
    return pn.worst_share(daily(spark, sf), ["zone"], "y", 0.05, "ts").select("zone", "ts")


@query("ord3_top_by_threshold", f"WITH {D}, q AS (SELECT zone, quantile_cont(y, 0.95) AS t FROM d GROUP BY 1) SELECT d.zone, d.ts FROM d JOIN q ON d.zone = q.zone WHERE y >= t")
def ord3(spark, sf):
    d = daily(spark, sf)
    return d.join(d.groupBy("zone").agg(F.percentile("y", F.lit(0.95)).alias("t")), "zone").filter("y >= t").select("zone", "ts")


@query("ord4_top_absolute", "SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 10")
def ord4(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc(F.abs("c_acctbal")), "c_custkey").limit(10)


@query("ord5_peak_key", f"WITH {H} SELECT zone, arg_max(ts, y) AS peak, arg_min(ts, y) AS trough FROM h GROUP BY 1")
def ord5(spark, sf):
    return hourly(spark, sf).groupBy("zone").agg(F.max_by("ts", "y").alias("peak"), F.min_by("ts", "y").alias("trough"))


@query("set1_union_all", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def set1(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_name").alias("name")).unionByName(table(spark, sf, "region").select(F.col("r_name").alias("name")))


@query("set2_axis_union", "SELECT CAST(o_orderdate AS DATE) AS day FROM orders UNION SELECT CAST(l_shipdate AS DATE) FROM lineitem")
def set2(spark, sf):
    a, b = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")), table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    return a.union(b).distinct()


@query("set3_intersection", "SELECT CAST(o_orderdate AS DATE) AS day FROM orders INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem")
def set3(spark, sf):
    a, b = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day")), table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day"))
    return a.intersect(b)


@query("set4_difference", "SELECT CAST(l_shipdate AS DATE) AS day FROM lineitem EXCEPT SELECT CAST(o_orderdate AS DATE) FROM orders")
def set4(spark, sf):
    a, b = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("day")), table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("day"))
    return a.subtract(b)
