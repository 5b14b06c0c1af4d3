"""Time: epochs, calendars, holidays, local clocks, grids and keys."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MICROS = 1_000_000


def micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zoneless timestamp, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def from_micros(x: Column) -> Column:
    return F.timestamp_add("MICROSECOND", x.cast("long"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def shift(ts: Column, seconds: int) -> Column:
    return F.timestamp_add("SECOND", F.lit(seconds), ts)


def parse_offset(text: Column) -> Column:
    """UTC instant of an ISO string with an offset, as a zoneless timestamp; null if it can't be read."""
    whole = F.regexp_extract(text, r"^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?)([+-]\d{2}:\d{2}|Z)$", 1)
    zone = F.regexp_extract(text, r"([+-]\d{2}:\d{2}|Z)$", 1)
    sign = F.when(zone.startswith("-"), -1).otherwise(1)
    minutes = F.when(zone == "Z", 0).otherwise(sign * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 5, 2).try_cast("int")))
    return F.timestamp_add("MINUTE", -minutes, F.replace(whole, F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz"))


def to_local(ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def offset_hours(local: Column, utc: Column) -> Column:
    return F.timestamp_diff("SECOND", utc, local) / 3600


def local_to_utc(local: Column, zone: str, repeated: Column) -> Column:
    """UTC of a wall clock; ``repeated`` marks the second pass of a repeated hour. Hours that don't exist give null."""
    first = F.convert_timezone(F.lit(zone), F.lit("UTC"), local)
    back = to_local(first, zone)
    return F.when(back != local, F.lit(None)).when(repeated, F.timestamp_add("HOUR", F.lit(1), first)).otherwise(first)


def hour_beginning(day: Column, hour_ending: Column) -> Column:
    """Start of the hour that a text like 01:00 ... 24:00 ends."""
    return F.timestamp_add("HOUR", F.split(hour_ending, ":")[0].cast("int") - 1, day.cast("timestamp_ntz"))


def calendar(df: DataFrame, ts: str = "ts", holidays: DataFrame | None = None) -> DataFrame:
    """hour, day_of_week (Monday 0), day_of_year, month, is_weekend and, with a holiday table (day), is_holiday."""
    t = F.col(ts)
    out = df.withColumns({
        "hour": F.hour(t), "day_of_week": F.weekday(t), "day_of_year": F.dayofyear(t), "month": F.month(t),
        "is_weekend": (F.weekday(t) >= 5).cast("int"),
    })
    if holidays is None:
        return out
    marked = holidays.select(F.col("day").alias("_day"), F.lit(1).alias("_holiday"))  # a few rows a year
    return out.join(F.broadcast(marked), F.to_date(t) == F.col("_day"), "left").withColumn("is_holiday", F.coalesce("_holiday", F.lit(0))).drop("_day", "_holiday")


def federal_holidays(first_year: int, last_year: int) -> list[date]:
    """United States federal holidays, each on its observed day."""

    def nth(year: int, month: int, weekday: int, n: int) -> date:
        d = date(year, month, 1)
        return d + timedelta((weekday - d.weekday()) % 7 + 7 * (n - 1))

    def last(year: int, month: int, weekday: int) -> date:
        d = date(year + month // 12, month % 12 + 1, 1) - timedelta(1)
        return d - timedelta((d.weekday() - weekday) % 7)

    def observed(d: date) -> date:
        return d + timedelta({5: -1, 6: 1}.get(d.weekday(), 0))

    out = []
    for y in range(first_year, last_year + 1):
        out += [observed(date(y, 1, 1)), nth(y, 1, 0, 3), nth(y, 2, 0, 3), last(y, 5, 0), observed(date(y, 7, 4)), nth(y, 9, 0, 1), nth(y, 10, 0, 2), observed(date(y, 11, 11)), nth(y, 11, 3, 4), observed(date(y, 12, 25))]
        if y >= 2021:
            out.append(observed(date(y, 6, 19)))
    return sorted(set(out))


def holiday_table(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    return spark.createDataFrame([(d,) for d in federal_holidays(first_year, last_year)], "day date")


def bridge_day(day: Column, is_holiday_before: Column, is_holiday_after: Column) -> Column:
    """A Friday after a Thursday holiday or a Monday before a Tuesday holiday."""
    return ((F.weekday(day) == 4) & is_holiday_before) | ((F.weekday(day) == 0) & is_holiday_after)


def round_to(ts: Column, hours: int) -> Column:
    """Nearest grid time; exact halves go to the even step, as rounding to even does."""
    step = hours * 3600 * MICROS
    m = micros(ts)
    q = F.floor(m / F.lit(step)).cast("long")
    rest = m - q * step
    up = (rest * 2 > step) | ((rest * 2 == step) & (F.pmod(q, F.lit(2)) == 1))
    return from_micros((q + up.cast("long")) * step)


def on_the_hour(df: DataFrame, ts: str) -> DataFrame:
    """The rows, if all stamps are on the hour; a stamp at another minute stops the query."""
    t = F.col(ts)
    off = (F.minute(t) != 0) | (F.second(t) != 0)
    told = F.raise_error(F.concat(F.lit("a stamp off the hour: "), t.cast("string"))).cast(dict(df.dtypes)[ts])
    return df.withColumn(ts, F.when(off, told).otherwise(t))


def iso_week(ts: Column) -> Column:
    """ISO year and week, not padded: 2025-1."""
    return F.concat_ws("-", F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.weekofyear(ts).cast("string"))


def month_id(ts: Column) -> Column:
    return F.year(ts) * 12 + F.month(ts)


def previous_weekday(day: Column, weekday: int) -> Column:
    """The last such weekday (Monday 0) strictly before the day."""
    return F.date_sub(day, F.pmod(F.weekday(day) - weekday - 1, F.lit(7)) + 1)


def days_to_month_part(day_of_month: Column, last_train: int = 18) -> Column:
    """Days from a test day to the nearest training day of a month split in blocks."""
    return F.greatest(day_of_month - last_train, F.lit(0))
