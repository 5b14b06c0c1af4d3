"""Column expressions: limits, encodings, sun angles, labels, safe arithmetic."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def clip(x: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def cyclic(x: Column, period: float) -> tuple[Column, Column]:
    a = x * (2 * math.pi / period)
    return F.sin(a), F.cos(a)


def cos_zenith(ts: Column, latitude: float, longitude: float) -> Column:
    """Cosine of the sun's zenith angle half an hour after ``ts``, from a Fourier series of the
    declination and of the equation of time; not below zero."""
    day = F.dayofyear(ts)
    g = (day - 1 + (F.hour(ts) + 0.5 - 12) / 24) * (2 * math.pi / 365)
    # Fourier coefficients of declination (rad) and equation of time (min).
    declination = 0.006918 - 0.399912 * F.cos(g) + 0.070257 * F.sin(g) - 0.006758 * F.cos(2 * g) + 0.000907 * F.sin(2 * g) - 0.002697 * F.cos(3 * g) + 0.00148 * F.sin(3 * g)
    equation = 229.18 * (0.000075 + 0.001868 * F.cos(g) - 0.032077 * F.sin(g) - 0.014615 * F.cos(2 * g) - 0.040849 * F.sin(2 * g))
    solar = (F.hour(ts) + 0.5) * 60 + F.minute(ts) + equation + 4 * longitude
    angle = (solar / 4 - 180) * (math.pi / 180)
    lat = math.radians(latitude)
    return F.greatest(F.lit(math.sin(lat)) * F.sin(declination) + F.lit(math.cos(lat)) * F.cos(declination) * F.cos(angle), F.lit(0.0))


def one_hot(column: str, values: list) -> list[Column]:
    return [(F.col(column) == v).cast("int").alias(f"{column}_{v}") for v in values]


def prioritised(cases: list[tuple[Column, object]], default: object) -> Column:
    """The first case that holds, in the order given."""
    out = F.lit(default)
    for condition, value in reversed(cases):
        out = F.when(condition, F.lit(value)).otherwise(out)
    return out


def usable(columns: list[str]) -> Column:
    """True where no column is null: the same rows for every model."""
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns], F.lit(True))


def wrap_longitude(x: Column) -> Column:
    return F.pmod(x + 180, F.lit(360.0)) - 180


def interval_label(low: Column, high: Column) -> Column:
    return F.format_string("[%+.2f, %+.2f]", low, high)


def own_zone(wide: DataFrame, key: str, zone: str, zones: list[str], variable: str) -> DataFrame:
    """Row-dependent lookup: column ``{zone}_{variable}`` of the row's own zone, as ``variable``."""
    pick = reduce(lambda acc, z: F.when(F.col(zone) == z, F.col(f"{z}_{variable}")).otherwise(acc), zones, F.lit(None))
    return wide.withColumn(variable, pick)


def check_filled(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    """Documented constants for nulls of the given columns; any other null number stops the query."""
    out = df.fillna(fills)
    rest = [c for c, t in df.dtypes if t in ("double", "float") and c not in fills]
    whole = usable(rest)
    first = df.columns[0]
    return out.withColumn(first, F.when(whole, F.col(first)).otherwise(F.raise_error(F.lit("a value is missing")).cast(dict(df.dtypes)[first])))


def starting(df: DataFrame, *prefixes: str) -> DataFrame:
    """The columns whose names begin with one of the prefixes, in their order."""
    return df.select(*[c for c in df.columns if c.startswith(prefixes)])


def ending(df: DataFrame, *suffixes: str) -> DataFrame:
    """The columns whose names end with one of the suffixes, in their order."""
    return df.select(*[c for c in df.columns if c.endswith(suffixes)])
