"""Temporal joins: nearest, backward, exact lag, latest known, preferred lead, interpolation, placebo.

As-of joins are windows over the union of both sides, so they sort by key and time once
and never compare pairs. Windows are cut by (key, time bucket), which keeps every sort
group bounded by the data of a bucket instead of a key's whole history.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeaxis import MICROS, micros, shift


#: Tolerances of a bucket of nearest_asof.
WIDE = 16


def _sides(left: DataFrame, right: DataFrame, by: list[str], values: list[str]) -> tuple[DataFrame, DataFrame]:
    lhs = left.withColumns({"_m": micros(F.col("ts")), "_left": F.struct(*[F.col(c) for c in left.columns])}).select(*by, "_m", "_left")
    rhs = right.filter(F.col("ts").isNotNull()).withColumn("_m", micros(F.col("ts")))
    rhs = rhs.select(*by, "_m", F.struct(F.col("_m").alias("m"), F.col("ts").alias("right_ts"), *[F.col(c) for c in values]).alias("_right"))
    return lhs, rhs


def nearest_asof(left: DataFrame, right: DataFrame, by: list[str], values: list[str], tolerance_s: int) -> DataFrame:
    """Each left row with the right row nearest in time, at most ``tolerance_s`` away (included); ties go to the earlier.

    Both sides have ``ts``. Windows span a bucket of ``WIDE`` tolerances each; a right row within
    the tolerance of its bucket's edge stands in the neighbouring bucket as well.
    """
    reach = max(tolerance_s, 1) * MICROS
    width = WIDE * reach
    lhs, rhs = _sides(left, right, by, values)
    lhs = lhs.withColumns({"_b": F.floor(F.col("_m") / F.lit(width)), "_right": F.lit(None).cast(rhs.schema["_right"].dataType), "_o": F.lit(1)})
    own = F.floor(F.col("_m") / F.lit(width))
    into = F.col("_m") - own * width
    rhs = rhs.withColumn("_b", F.explode(F.array_compact(F.array(F.when(into <= reach, own - 1), own, F.when(into >= width - reach, own + 1)))))
    rhs = rhs.withColumns({"_left": F.lit(None).cast(lhs.schema["_left"].dataType), "_o": F.lit(0)})
    both = lhs.unionByName(rhs)
    up = Window.partitionBy(*by, "_b").orderBy("_m", "_o").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by, "_b").orderBy(F.desc("_m"), F.desc("_o")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumns({"_back": F.last("_right", ignorenulls=True).over(up), "_next": F.last("_right", ignorenulls=True).over(down)}).filter("_o = 1")
    bd = F.col("_m") - F.col("_back.m")
    fd = F.col("_next.m") - F.col("_m")
    best = F.when(bd.isNotNull() & (fd.isNull() | (bd <= fd)), F.col("_back")).otherwise(F.col("_next"))
    found = found.withColumn("_best", best)
    near = F.abs(F.col("_best.m") - F.col("_m")) <= tolerance_s * MICROS
    return found.select("_left.*", *[F.when(near, F.col(f"_best.{c}")).alias(c) for c in ("right_ts", *values)])


def backward_asof(left: DataFrame, right: DataFrame, by: list[str], values: list[str], bucket_s: int = 30 * 86400, strict: bool = False) -> DataFrame:
    """Each left row with the last right row not after it (``strict``: before it), however long ago.

    Inside a bucket by a window; what was last before the bucket comes from one summary row
    a (key, bucket).
    """
    width = bucket_s * MICROS
    lhs, rhs = _sides(left, right, by, values)
    lhs = lhs.withColumn("_b", F.floor(F.col("_m") / F.lit(width)))
    rhs = rhs.withColumn("_b", F.floor(F.col("_m") / F.lit(width)))
    last = rhs.groupBy(*by, "_b").agg(F.max_by("_right", "_m").alias("_last"))
    marks = last.select(*by, "_b", "_last").unionByName(lhs.select(*by, "_b").distinct().withColumn("_last", F.lit(None).cast(last.schema["_last"].dataType)))
    marks = marks.groupBy(*by, "_b").agg(F.max("_last").alias("_last"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = marks.select(*by, "_b", F.last("_last", ignorenulls=True).over(before).alias("_carry"))
    order = 0 if strict else 1
    both = lhs.withColumns({"_right": F.lit(None).cast(rhs.schema["_right"].dataType), "_o": F.lit(order)}).unionByName(
        rhs.withColumns({"_left": F.lit(None).cast(lhs.schema["_left"].dataType), "_o": F.lit(1 - order)})
    )
    up = Window.partitionBy(*by, "_b").orderBy("_m", "_o").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_back", F.last("_right", ignorenulls=True).over(up)).filter("_left is not null")
    keys = [F.col(f"f.{k}").eqNullSafe(F.col(f"c.{k}")) for k in [*by, "_b"]]
    condition = keys[0]
    for k in keys[1:]:
        condition = condition & k
    joined = found.alias("f").join(carried.alias("c"), condition, "left")
    best = F.coalesce("_back", "_carry")
    return joined.select("_left.*", *[best.getField(c).alias(c) for c in ("right_ts", *values)])


def exact_lag(df: DataFrame, by: list[str], value: str, lags_s: dict[str, int]) -> DataFrame:
    """The value at exactly ``ts`` minus each lag; null where that time is missing. Keys are unique.

    Every value goes once to each time at which it is a lag; one join gives all lags.
    """
    places = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).cast("long").alias("s")) for n, s in lags_s.items()]))
    moved = df.select(*by, "ts", F.col(value).alias("_v"), places.alias("_lag")).withColumn("ts", F.timestamp_add("SECOND", F.col("_lag.s"), F.col("ts")))
    past = moved.groupBy(*by, "ts").agg(*[F.max(F.when(F.col("_lag.name") == n, F.col("_v"))).alias(n) for n in lags_s])
    return df.join(past, [*by, "ts"], "left")


def latest_known(versions: DataFrame, key: list[str], value: str, created: str, known: Column) -> DataFrame:
    """Of each key's versions that ``known`` admits, the value created last, the greatest of several at once."""
    return versions.filter(known).groupBy(*key).agg(F.max_by(value, F.struct(created, value)).alias(value), F.max(created).alias(created))


def preferred(options: DataFrame, key: list[str], value: str, rank: str, allowed: list[int]) -> DataFrame:
    """Of the allowed alternatives the one of least rank (lead 24 if there, else 27), the greatest value of several."""
    return options.filter(F.col(rank).isin(allowed) & F.col(value).isNotNull()).groupBy(*key).agg(F.max_by(value, F.struct(-F.col(rank), F.col(value))).alias(value), F.min(rank).alias(rank))


def _around(df: DataFrame, by: list[str], value: str, bucket_s: int) -> DataFrame:
    """Adds ``_m`` (micros), ``_a`` and ``_z``: the known (m, v) last at or before a row and first at or after it.

    Inside a time bucket by windows; what lies beyond comes from one summary row a (key, bucket).
    """
    df = df.withColumn("_m", micros(F.col("ts"))).withColumn("_b", F.floor(F.col("_m") / F.lit(bucket_s * MICROS)))
    df = df.withColumn("_k", F.when(F.col(value).isNotNull(), F.struct(F.col("_m").alias("m"), F.col(value).alias("v"))))
    marks = df.groupBy(*by, "_b").agg(F.min("_k").alias("_first"), F.max("_k").alias("_last"))
    # a row a bucket; what follows is taken in falling order, as a frame that only grows costs one step a row
    before, after = (Window.partitionBy(*by).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_b"), F.desc("_b")))
    marks = marks.select(*by, "_b", F.last("_last", ignorenulls=True).over(before).alias("_before"), F.last("_first", ignorenulls=True).over(after).alias("_after"))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"k.{k}")) for k in [*by, "_b"]]
    joined = df.alias("d").join(marks.alias("k"), reduce(and_, same)).select("d.*", "_before", "_after")
    up, down = (Window.partitionBy(*by, "_b").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc("_m"), F.desc("_m")))
    last, first = F.last("_k", ignorenulls=True).over(up), F.last("_k", ignorenulls=True).over(down)
    return joined.withColumns({"_a": F.coalesce(last, "_before"), "_z": F.coalesce(first, "_after")}).drop("_b", "_k", "_before", "_after")


def interpolate(df: DataFrame, by: list[str], value: str, bucket_s: int = 30 * 86400) -> DataFrame:
    """Adds ``filled``: linear in time between known values; nothing before the first, the last held after it."""
    a, z = F.col("_a"), F.col("_z")
    line = a.v + (z.v - a.v) * (F.col("_m") - a.m) / (z.m - a.m)
    filled = F.when(a.isNull(), F.lit(None)).when(z.isNull() | (z.m == a.m), a.v).otherwise(line)
    return _around(df, by, value, bucket_s).withColumn("filled", filled).drop("_m", "_a", "_z")


def forward_fill(df: DataFrame, by: list[str], value: str, bucket_s: int = 30 * 86400) -> DataFrame:
    """Adds ``filled``: the last known value at or before each row."""
    return _around(df, by, value, bucket_s).withColumn("filled", F.col("_a.v")).drop("_m", "_a", "_z")


def placebo(df: DataFrame, by: list[str], value: str, shift_s: int) -> DataFrame:
    """The value at another time: ``shift_s`` later, else as much earlier, else the row's own, as ``placebo``."""
    later = df.select(*by, shift(F.col("ts"), -shift_s).alias("ts"), F.col(value).alias("_later"))
    earlier = df.select(*by, shift(F.col("ts"), shift_s).alias("ts"), F.col(value).alias("_earlier"))
    out = df.join(later, [*by, "ts"], "left").join(earlier, [*by, "ts"], "left")
    return out.withColumn("placebo", F.coalesce("_later", "_earlier", value)).drop("_later", "_earlier")


def permuted(df: DataFrame, group: list[str], key: str, value: str, seed: int) -> DataFrame:
    """Values dealt anew inside each group, in the order of md5(seed|key), as ``placebo``."""
    natural = Window.partitionBy(*group).orderBy(key)
    dealt = Window.partitionBy(*group).orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key)
    own = df.withColumn("_n", F.row_number().over(natural))
    other = df.select(*group, F.row_number().over(dealt).alias("_n"), F.col(value).alias("placebo"))
    return own.join(other, [*group, "_n"]).drop("_n")


def days_to_nearest(days: DataFrame, by: list[str], known: str) -> DataFrame:
    """Adds ``distance``: days from each row's ``day`` to the nearest day of its key on which ``known`` holds; null if none."""
    marked = days.withColumn("ts", F.col("day").cast("timestamp_ntz")).withColumn("_known", F.when(F.col(known), F.lit(1)))
    found = _around(marked, by, "_known", 365 * 86400)
    away = F.least(F.col("_m") - F.col("_a.m"), F.col("_z.m") - F.col("_m"))
    return found.withColumn("distance", F.floor(away / F.lit(86400 * MICROS)).cast("int")).drop("ts", "_known", "_m", "_a", "_z")


def interval_join(left: DataFrame, right: DataFrame, by: list[str], left_ends: tuple[str, str], right_ends: tuple[str, str], bucket_s: int) -> DataFrame:
    """Pairs of equal ``by`` whose intervals [start, end) overlap, each pair once: ``by``, the left columns, the right ones.

    Both sides are cut by time bucket and meet there by equality; of the buckets that a pair
    shares it counts in that of the later start. An interval stands in as many buckets as it
    touches, so a bucket should be about as long as the intervals. Empty intervals and nulls meet nothing.
    """
    width = bucket_s * MICROS
    at = lambda c: F.floor(micros(F.col(c)) / F.lit(width))

    def cut(df: DataFrame, ends: tuple[str, str], name: str) -> DataFrame:
        start, end = ends
        last = F.floor((micros(F.col(end)) - 1) / F.lit(width))
        rest = F.struct(*[F.col(c) for c in df.columns if c not in by])
        return df.filter(F.col(start) < F.col(end)).select(*by, F.explode(F.sequence(at(start), last)).alias("_b"), at(start).alias(f"_at_{name}"), rest.alias(name))

    both = cut(left, left_ends, "_l").join(cut(right, right_ends, "_r"), [*by, "_b"])
    ls, le, rs, re_ = F.col(f"_l.{left_ends[0]}"), F.col(f"_l.{left_ends[1]}"), F.col(f"_r.{right_ends[0]}"), F.col(f"_r.{right_ends[1]}")
    return both.filter((ls < re_) & (rs < le) & (F.col("_b") == F.greatest("_at__l", "_at__r"))).select(*by, "_l.*", "_r.*")


def lead_lags(df: DataFrame, by: list[str], value: str, lead_days: int) -> DataFrame:
    """Lags known at a lead of so many days: the lead, a day more, and the same weekday one or two weeks before."""
    week = 7 if lead_days <= 7 else 14
    lags = {"lag_lead": lead_days, "lag_next": lead_days + 1, "lag_week": week}
    return exact_lag(df, by, value, {n: d * 86400 for n, d in lags.items()}).withColumn("lead", F.lit(lead_days))


def near_days(held_out: DataFrame, days: int) -> DataFrame:
    """Distinct days within ``days`` of a held-out ``day``."""
    return held_out.select(F.explode(F.sequence(F.date_sub("day", days), F.date_add("day", days))).alias("day")).distinct()


def at_all(df: DataFrame, key: list[str], member: str, members: list) -> DataFrame:
    """Rows of keys that are there for every member (relational division)."""
    full = df.filter(F.col(member).isin(members)).groupBy(*key).agg(F.countDistinct(member).alias("_n")).filter(F.col("_n") == len(members))
    return df.join(full.drop("_n"), key, "left_semi")
