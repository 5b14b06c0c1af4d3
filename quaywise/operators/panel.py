"""Aggregates and windows over panels."""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timeaxis import MICROS, micros


def sum_at_least(x: Column, n: int) -> Column:
    """Sum of a group, null if it has fewer than ``n`` values."""
    return F.when(F.count(x) >= n, F.sum(x))


def sum_if_all(x: Column, part: Column, n: int) -> Column:
    """Sum of a group, null unless it has ``n`` distinct parts."""
    return F.when(F.countDistinct(part) == n, F.sum(x))


def keep_one(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key, the first in ``order`` (which must leave no ties)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def share_weights(df: DataFrame, part: str, value: str) -> DataFrame:
    """(part, weight): each part's share of the whole."""
    sums = df.groupBy(part).agg(F.sum(value).alias("_s"))
    total = sums.agg(F.sum("_s").alias("_t"))
    return sums.crossJoin(F.broadcast(total)).select(part, (F.col("_s") / F.col("_t")).alias("weight"))  # one row


def weighted_mean(df: DataFrame, weights: DataFrame, part: str, key: list[str], value: str) -> DataFrame:
    joined = df.join(weights, part).filter(F.col(value).isNotNull())
    return joined.groupBy(*key).agg((F.sum(F.col(value) * F.col("weight")) / F.sum("weight")).alias(value))


def average_rank(value: str, by: list[str]) -> Column:
    """Rank from 1, equal values sharing the mean of their ranks; for groups that a task can sort."""
    w = Window.partitionBy(*by).orderBy(value)
    ties = Window.partitionBy(*by, value)
    return F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0


def percent_rank_average(value: str, by: list[str]) -> Column:
    """Average rank over the group's size; for groups that a task can sort."""
    return average_rank(value, by) / F.count(F.lit(1)).over(Window.partitionBy(*by))


def in_value_ranges(df: DataFrame, value: str, by: list[str], parts: int = 64) -> DataFrame:
    """Adds ``_range`` (0, 1, ... in rising order of value, nulls first), ``_here`` (rows of the
    range), ``_below`` (rows of the group in lower ranges) and ``_size`` (rows of the group).

    The edges are approximate quantiles, a row a group; what is counted from them is exact
    wherever they lie. So ranks of a large group are windows over its ranges, not over it.
    """
    number = F.col(value).cast("double") if dict(df.dtypes)[value] not in ("date", "timestamp", "timestamp_ntz") else F.unix_micros(F.col(value).cast("timestamp")).cast("double")
    df = df.withColumn("_number", number)
    edges = df.groupBy(*by).agg(F.percentile_approx("_number", [k / parts for k in range(1, parts)], 10_000).alias("_edges"))
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in by]
    placed = df.alias("d").join(edges.alias("e"), reduce(and_, same("d", "e"), F.lit(True))).select("d.*", F.expr("aggregate(_edges, 0, (n, e) -> n + if(_number > e, 1, 0))").alias("_range"))
    sizes = placed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*by)
    sizes = sizes.select(*by, "_range", F.col("_n").alias("_here"), (F.sum("_n").over(whole.orderBy("_range")) - F.col("_n")).alias("_below"), F.sum("_n").over(whole).alias("_size"))
    key = reduce(and_, same("p", "s"), F.col("p._range") == F.col("s._range"))
    return placed.alias("p").join(sizes.alias("s"), key).select("p.*", "_here", "_below", "_size").drop("_number")


def ranked(df: DataFrame, value: str, by: list[str], name: str, percent: bool = False) -> DataFrame:
    """Average ranks (``percent``: over the group's size) of groups of any size."""
    rank = F.col("_below") + average_rank(value, [*by, "_range"])
    return in_value_ranges(df, value, by).withColumn(name, rank / F.col("_size") if percent else rank).drop("_range", "_here", "_below", "_size")


def numbered_by(df: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """Adds each row's place in its group in order of ``value``, from 1; groups of any size, values distinct."""
    w = Window.partitionBy(*by, "_range").orderBy(value)
    return in_value_ranges(df, value, by).withColumn(name, (F.col("_below") + F.row_number().over(w)).cast("long")).drop("_range", "_here", "_below", "_size")


def numbered(df: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """Adds a number from 0 in order of ``value`` and then ``key``, over all rows: counts of ranges of values, then windows inside them."""
    w = Window.partitionBy("_range").orderBy(value, key)
    return in_value_ranges(df, value, []).withColumn(name, (F.col("_below") + F.row_number().over(w) - 1).cast("long")).drop("_range", "_here", "_below", "_size")


def exact_quantiles(df: DataFrame, value: str, by: list[str], wanted: dict[str, float]) -> DataFrame:
    """(by, names): exact quantiles of groups of any size, linear between neighbours; nulls don't count.

    Only the ranges of values that hold the wanted ranks are sorted.
    """
    placed = in_value_ranges(df.select(*by, value).filter(F.col(value).isNotNull()), value, by)
    at = {n: F.lit(q) * (F.col("_size") - 1) for n, q in wanted.items()}
    holds = [(F.col("_below") <= F.ceil(x)) & (F.col("_below") + F.col("_here") > F.floor(x)) for x in at.values()]
    place = F.col("_below") + F.row_number().over(Window.partitionBy(*by, "_range").orderBy(value)) - 1
    near = placed.filter(reduce(or_, holds)).withColumn("_place", place)
    ends = []
    for n, x in at.items():
        ends += [F.max(F.when(F.col("_place") == F.floor(x), F.col(value))).alias(f"_a_{n}"), F.max(F.when(F.col("_place") == F.ceil(x), F.col(value))).alias(f"_z_{n}"), F.max(x - F.floor(x)).alias(f"_s_{n}")]
    found = near.groupBy(*by).agg(*ends)
    return found.select(*by, *[(F.col(f"_a_{n}") + (F.col(f"_z_{n}") - F.col(f"_a_{n}")) * F.col(f"_s_{n}")).alias(n) for n in wanted])


def exact_quantile(df: DataFrame, value: str, by: list[str], q: float, name: str) -> DataFrame:
    """(by, name): one exact quantile of groups of any size."""
    return exact_quantiles(df, value, by, {name: q})


def in_time_buckets(df: DataFrame, seconds: int, wide: int = 16) -> DataFrame:
    """Adds ``_bucket``, of ``wide`` frames each; a row within a frame of the next bucket stands there as well, with ``_own`` false."""
    width, at = wide * seconds * MICROS, micros(F.col("ts"))
    bucket = F.floor(at / F.lit(width))
    near = at - bucket * width > width - seconds * MICROS
    both = df.withColumn("_bucket", F.explode(F.when(near, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))))
    return both.withColumn("_own", F.col("_bucket").eqNullSafe(bucket))


def over_trailing(df: DataFrame, by: list[str], seconds: int, name: str, of) -> DataFrame:  # noqa: ANN001
    """Adds ``of(window)`` over the frame (t - seconds, t], left edge open; windows span a time bucket, not a key's history."""
    w = Window.partitionBy(*by, "_bucket").orderBy(micros(F.col("ts"))).rangeBetween(-(seconds * MICROS - 1), 0)
    return in_time_buckets(df, seconds).withColumn(name, of(w)).filter("_own").drop("_bucket", "_own")


def rolling_mean(df: DataFrame, by: list[str], value: str, seconds: int, name: str) -> DataFrame:
    return over_trailing(df, by, seconds, name, lambda w: F.avg(value).over(w))


class OrderedValues:
    """Values in order, in blocks of bounded size: adding, removing and the k-th one touch one block."""

    MOST = 512

    def __init__(self):
        self.blocks: list[list[float]] = []
        self.tops: list[float] = []
        self.size = 0

    def add(self, x: float) -> None:
        self.size += 1
        if not self.blocks:
            self.blocks, self.tops = [[x]], [x]
            return
        k = min(bisect_left(self.tops, x), len(self.tops) - 1)
        block = self.blocks[k]
        insort(block, x)
        if len(block) > self.MOST:
            half = len(block) // 2
            self.blocks[k : k + 1] = block[:half], block[half:]
            self.tops.insert(k, block[half - 1])
            k += 1
        self.tops[k] = self.blocks[k][-1]

    def remove(self, x: float) -> None:
        self.size -= 1
        k = bisect_left(self.tops, x)
        block = self.blocks[k]
        del block[bisect_left(block, x)]
        if block:
            self.tops[k] = block[-1]
        else:
            del self.blocks[k], self.tops[k]

    def at(self, k: int) -> float:
        for block in self.blocks:
            if k < len(block):
                return block[k]
            k -= len(block)
        raise IndexError(k)

    def quantile(self, q: float) -> float:
        place = q * (self.size - 1)
        low = int(place)
        a = self.at(low)
        return a if low == place else a + (self.at(low + 1) - a) * (place - low)


def rolling_quantile(df: DataFrame, by: list[str], value: str, seconds: int, q: float, least: int, name: str) -> DataFrame:
    """Exact quantile of the time frame (t - seconds, t]; null where it has fewer than ``least`` values.

    In each (key, time bucket) a row's value enters an ordered structure once and leaves it
    once, so a bucket costs n log n however long the frame is. Nulls don't count; rows of equal
    time see one frame. Further columns stay.
    """
    import numpy as np
    import pyarrow as pa

    columns, wide = df.columns, seconds * MICROS

    def run(part: pa.Table) -> pa.Table:
        t, x, own = (part.column(c).to_numpy() for c in ("_t", "_x", "_own"))
        order = np.argsort(t, kind="stable")
        known = ~np.isnan(x)
        times, values, there = t[order].tolist(), x[order].tolist(), known[order].tolist()
        held, out = OrderedValues(), np.full(len(t), np.nan)
        first = last = 0
        n = len(times)
        for k in range(n):
            now = times[k]
            if k and now == times[k - 1]:
                out[order[k]] = out[order[k - 1]]
                continue
            while last < n and times[last] <= now:
                if there[last]:
                    held.add(values[last])
                last += 1
            while times[first] <= now - wide:
                if there[first]:
                    held.remove(values[first])
                first += 1
            if held.size >= max(least, 1):
                out[order[k]] = held.quantile(q)
        kept = part.select(columns).append_column(name, pa.array(out, mask=np.isnan(out)))
        return kept.filter(pa.array(own))

    placed = in_time_buckets(df, seconds).withColumns({"_t": micros(F.col("ts")), "_x": F.coalesce(F.col(value).cast("double"), F.lit(float("nan")))})
    return placed.groupBy(*by, "_bucket").applyInArrow(run, df.schema.add(name, "double"))


def quantile_bins(df: DataFrame, value: str, bins: int, name: str = "bin") -> DataFrame:
    """Bins between exact quantile edges, closed on the right; the least value falls into bin 0."""
    ends = exact_quantiles(df, value, [], {f"_q{k}": k / bins for k in range(1, bins)})
    edges = ends.select(F.array(*[F.col(f"_q{k}") for k in range(1, bins)]).alias("_edges"))
    joined = df.crossJoin(F.broadcast(edges))  # one row of edges
    return joined.withColumn(name, F.expr(f"aggregate(_edges, 0, (n, e) -> n + if({value} > e, 1, 0))")).drop("_edges")


def deseasonalised(value: str, by: list[str]) -> Column:
    return F.col(value) - F.avg(value).over(Window.partitionBy(*by))


def daily_difference(df: DataFrame, by: list[str], value: str, day: str, name: str) -> DataFrame:
    """Adds the difference to the day before; null where that day is missing. Days of a key are unique."""
    before = df.select(*by, F.date_add(day, 1).alias(day), F.col(value).alias("_before"))
    return df.join(before, [*by, day], "left").withColumn(name, F.col(value) - F.col("_before")).drop("_before")


def worst_share(df: DataFrame, by: list[str], value: str, share: float, key: str) -> DataFrame:
    """The rows of greatest value of each group, of any size: round(share * n) of them, halves to even; ties by ``key``."""
    w = Window.partitionBy(*by, "_range")
    from_top = F.col("_size") - F.col("_below") - F.count(F.lit(1)).over(w) + F.row_number().over(w.orderBy(F.desc(value), key))
    placed = in_value_ranges(df, value, by).withColumn("_place", from_top)
    return placed.filter(F.col("_place") <= F.bround(F.lit(share) * F.col("_size"), 0)).drop("_range", "_here", "_below", "_size", "_place")


def pivot_strict(df: DataFrame, key: list[str], column: str, value: str, values: list) -> DataFrame:
    """Columns from rows; two rows for one cell stop the query."""
    one = F.when(F.count(value) > 1, F.raise_error(F.lit("two rows for one cell")).cast("double")).otherwise(F.min(value))
    return df.groupBy(*key).pivot(column, values).agg(one)
