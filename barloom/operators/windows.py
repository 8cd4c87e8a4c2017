"""Windows over keyed series: rolling means, latest rows, limited fills and as-of values. All partition by the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

EXACT = "decimal(24,6)"


def series(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def last_rows(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def rolling_mean(c: Column, w: WindowSpec, n: int, min_periods: int = 1, exact: bool = True) -> Column:
    """Mean of the last n rows, from min_periods non-NULL ones on. Exact sums make equal frames compare as equal, in any order of addition."""
    frame = last_rows(w, n)
    total = F.sum(c.cast(EXACT) if exact else c).over(frame).cast("double")
    seen = F.count(c).over(frame)
    return F.when(seen >= min_periods, total / F.nullif(seen, F.lit(0)))


def rolling_std(c: Column, w: WindowSpec, n: int, min_periods: int = 2) -> Column:
    frame = last_rows(w, n)
    return F.when(F.count(c).over(frame) >= min_periods, F.stddev_samp(c).over(frame))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by `order`. All other columns, by name, break ties, so the pick is the same every time."""
    rest = [F.col(c) for c in sorted(set(df.columns) - set(keys))]
    w = Window.partitionBy(*keys).orderBy(*order, *rest)
    return df.withColumn("_rank_", F.row_number().over(w)).where("_rank_ = 1").drop("_rank_")


def carried(c: Column, w: WindowSpec, limit: int) -> Column:
    """The last non-NULL value, carried over at most `limit` rows."""
    up_to_now = w.rowsBetween(Window.unboundedPreceding, 0)
    place = F.row_number().over(w)
    seen = F.last(F.when(c.isNotNull(), F.struct(place.alias("at"), c.alias("v"))), ignorenulls=True).over(up_to_now)
    return F.when(place - seen["at"] <= limit, seen["v"])


def fill_forward(df: DataFrame, column: str, keys: Sequence[str], limit: int, order: str = "date") -> DataFrame:
    """`column` filled forward over at most `limit` rows of the calendar, and `<column>_filled` where it was."""
    w = series(*keys, order=order)
    placed = df.withColumn("_at_", F.row_number().over(w))
    seen = F.last(F.when(F.col(column).isNotNull(), F.struct(F.col("_at_").alias("at"), F.col(column).alias("v"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = placed.withColumn("_seen_", seen).withColumn("_value_", F.when(F.col("_at_") - F.col("_seen_.at") <= limit, F.col("_seen_.v")))
    return out.withColumn(f"{column}_filled", F.col(column).isNull() & F.col("_value_").isNotNull()).withColumn(column, F.col("_value_")).drop("_at_", "_seen_", "_value_")


def interpolate(df: DataFrame, column: str, keys: Sequence[str], limit: int = 2, order: str = "date") -> DataFrame:
    """Linear interpolation inside gaps, at most `limit` rows from the gap's start and none at the edges."""
    w = series(*keys, order=order)
    placed = df.withColumn("_at_", F.row_number().over(w))
    point = F.when(F.col(column).isNotNull(), F.struct(F.col("_at_").alias("at"), F.col(column).alias("v")))
    before = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = placed.withColumns({"_b_": before, "_a_": after})
    k, gap = F.col("_at_") - F.col("_b_.at"), F.col("_a_.at") - F.col("_b_.at")
    inside = F.when(k <= limit, F.col("_b_.v") + (F.col("_a_.v") - F.col("_b_.v")) * k / gap)
    return both.withColumn(column, F.coalesce(F.col(column), inside)).drop("_at_", "_a_", "_b_")


def asof(left: DataFrame, right: DataFrame, keys: Sequence[str], value: str, max_rows: int, order: str = "date") -> DataFrame:
    """left with the latest `value` of right at or before its date, at most max_rows rows of the two calendars' union old.

    One union and one window by key: no range join, and a value is carried however many rows share a key.
    """
    mine = left.select(*keys, order).distinct().withColumn("_mine_", F.lit(True)).withColumn(value, F.lit(None).cast(right.schema[value].dataType))
    other = right.select(*keys, order, F.lit(False).alias("_mine_"), value)
    days = mine.unionByName(other).groupBy(*keys, order).agg(F.max("_mine_").alias("_mine_"), F.max(value).alias(value))
    w = series(*keys, order=order)
    known = days.withColumn(value, carried(F.col(value), w, max_rows)).where("_mine_").drop("_mine_")
    return left.join(known, [*keys, order], "left")
