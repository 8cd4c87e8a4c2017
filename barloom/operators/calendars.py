"""Calendars as tables: days, business days, and the last or first days of months, quarters and years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a calendar keeps of all days; weekdays count from Sunday as 1.
KINDS = {
    "day": None,
    "business": "dayofweek(date) NOT IN (1, 7)",
    **{f"{unit}_end": f"trunc(date_add(date, 1), '{unit}') <> trunc(date, '{unit}')" for unit in ("month", "quarter", "year")},
    **{f"{unit}_start": f"trunc(date, '{unit}') = date" for unit in ("month", "quarter", "year")},
}


def calendar(spark: SparkSession, start: str, end: str, kind: str = "day") -> DataFrame:
    """(date) from start to end, both included, of a kind; empty if end is before start. Made of a range of numbers, so it is dealt over tasks like any table."""
    if kind not in KINDS:
        raise ValueError(f"no calendar of kind {kind}; there are {', '.join(KINDS)}")
    first = F.lit(start).cast("date")
    last = spark.range(1).select(F.datediff(F.lit(end).cast("date"), first).alias("n")).first()["n"]
    days = spark.range(max(0, (last if last is not None else -1) + 1)).select(F.date_add(first, F.col("id").cast("int")).alias("date"))
    return days.where(KINDS[kind]) if KINDS[kind] else days
