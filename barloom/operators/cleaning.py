"""Cleaning and staging of raw tables, keyed deduplication, quality reports and data-quality rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.nullsafe import finite, strict_greatest, strict_least
from barloom.operators.windows import latest_per_key

PRICES = ("open", "high", "low", "close", "adjusted_close", "volume")


def align(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order: missing ones NULL, the others cast where they can be."""
    return df.select(*((F.expr(f"try_cast(`{f.name}` AS {f.dataType.simpleString()})") if f.name in df.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def staged(raw: DataFrame, types: Mapping[str, str], keys: Sequence[str], stamp: str = "ingested_at") -> DataFrame:
    """Typed columns, no NULL keys, and the row stamped last of each key; remaining ties are broken by all columns."""
    typed = raw.select(*(F.expr(f"try_cast(`{c}` AS {t})").alias(c) for c, t in types.items()))
    some = typed.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return latest_per_key(some, keys, [F.desc(stamp)])


def clean_market(raw: DataFrame, may_be_negative: Sequence[str] = ()) -> DataFrame:
    """One sound bar for each (symbol, date): the most complete row, flags of what was missing, high and low widened to hold all prices.

    Infinite and NaN numbers count as missing, adjusted_close falls back to close, volume_filled to 0; bars without a
    close are dropped, and so are bars with a price of 0 or less, except of symbols that may be negative.
    """
    numbers = raw.withColumns({c: finite(F.expr(f"try_cast(`{c}` AS double)")) for c in PRICES}).withColumn("date", F.expr("try_cast(date AS date)"))
    flagged = numbers.withColumns({f"{c}_was_missing": F.col(c).isNull().cast("int") for c in PRICES}).where("symbol IS NOT NULL AND date IS NOT NULL").dropDuplicates()
    complete = sum((F.col(c).isNotNull().cast("int") for c in PRICES[1:]), F.col(PRICES[0]).isNotNull().cast("int"))
    one = latest_per_key(flagged, ["symbol", "date"], [complete.desc()])
    filled = one.withColumn("adjusted_close", F.coalesce("adjusted_close", "close")).withColumn("volume_filled", F.coalesce("volume", F.lit(0.0))).where("close IS NOT NULL")
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    wide = filled.withColumns({"high": F.greatest(*prices), "low": F.least(*prices)})
    sound = F.least(*[F.col(c) for c in ("open", "high", "low", "close")]) > 0
    return wide.where(sound | F.col("symbol").isin(*may_be_negative) if may_be_negative else sound)


def quality_report(raw: DataFrame) -> DataFrame:
    """By symbol: rows, duplicate dates, missing and non-positive closes, inconsistent bars, first and last date."""
    return raw.groupBy("symbol").agg(
        F.count("*").alias("rows"), (F.count("*") - F.count_distinct("date")).alias("duplicates"), F.count_if(F.col("close").isNull()).alias("missing_close"), F.count_if(F.col("close") <= 0).alias("non_positive"),
        F.count_if((F.col("high") < F.greatest("open", "low", "close")) | (F.col("low") > F.least("open", "high", "close"))).alias("inconsistent"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )


CORE = ("open", "high", "low", "close", "adjusted_close")


def judged(raw: DataFrame, order: Column) -> DataFrame:
    """Rows with typed numbers, `fate` (no_date, duplicate, empty, missing_close, non_positive or kept) and `inconsistent` bars.

    Of the rows of a symbol and date the last one by `order` counts, all columns breaking ties. Fates are judged in
    this order; a bar is empty without any price, and non-positive if any price it has is 0 or less.
    """
    typed = raw.withColumns({c: finite(F.expr(f"try_cast(`{c}` AS double)")) for c in (*CORE, "volume")}).withColumn("date", F.expr("try_cast(date AS date)"))
    rest = [F.col(c) for c in sorted(set(raw.columns) - {"symbol", "date"})]
    place = F.row_number().over(Window.partitionBy("symbol", "date").orderBy(order.desc(), *rest))
    prices = F.array(*CORE)
    fate = F.when(F.col("date").isNull(), "no_date").when(place > 1, "duplicate").when(F.forall(prices, lambda p: p.isNull()), "empty").when(F.col("close").isNull() | F.col("adjusted_close").isNull(), "missing_close").when(F.exists(prices, lambda p: p <= 0), "non_positive").otherwise("kept")
    highest, lowest = (f(*CORE[:4]) for f in (F.greatest, F.least))
    return typed.withColumn("fate", fate).withColumn("inconsistent", (F.col("fate") == "kept") & F.coalesce((F.col("high") < highest) | (F.col("low") > lowest), F.lit(False)))


def fate_counters() -> dict[str, Column]:
    """Aggregates over judged rows: what came, what went and why, what was mended, and what was missing in rows that were looked at."""
    looked = F.col("fate").isin("missing_close", "non_positive", "kept")
    counts = {"rows_downloaded": F.count(F.lit(1)), "rows_after_cleaning": F.count_if(F.col("fate") == "kept"), "duplicate_dates_removed": F.count_if(F.col("fate") == "duplicate"), "empty_rows_dropped": F.count_if(F.col("fate") == "empty"), "non_positive_price_rows_dropped": F.count_if(F.col("fate") == "non_positive"), "ohlc_inconsistent_rows_fixed": F.count_if(F.col("inconsistent"))}
    return {**counts, **{f"{c}_missing": F.count_if(looked & F.col(c).isNull()) for c in (*CORE, "volume")}}


def quality_counters(rows: DataFrame) -> DataFrame:
    """By symbol, of judged() rows: the counters, and first and last date of what is kept."""
    kept = F.when(F.col("fate") == "kept", F.col("date"))
    return rows.groupBy("symbol").agg(*(c.alias(n) for n, c in fate_counters().items()), F.min(kept).alias("first_date"), F.max(kept).alias("last_date"))


def mended(rows: DataFrame, observation: Observation | None = None) -> DataFrame:
    """The kept ones of judged() rows, high and low widened to hold all prices.

    With an observation the counters over all symbols are gathered while the result is written: no pass of their own.
    """
    seen = rows.observe(observation, *(c.alias(n) for n, c in fate_counters().items())) if observation is not None else rows
    return seen.where("fate = 'kept'").withColumns({"high": F.greatest(*CORE[:4]), "low": F.least(*CORE[:4])}).drop("fate", "inconsistent")


def missing_report(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """By column: missing before and after, treated, and the rate before."""
    count = lambda df, name: df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns), F.count("*").alias("_rows_")).unpivot("_rows_", list(columns), "column", name)
    b, a = count(before, "missing_before"), count(after, "missing_after").drop("_rows_")
    return b.join(a, "column").select("column", "missing_before", "missing_after", (F.col("missing_before") - F.col("missing_after")).alias("treated"), F.try_divide(100.0 * F.col("missing_before"), F.col("_rows_")).alias("missing_rate"))


def clean_news(raw: DataFrame, order: Column) -> DataFrame:
    """Trimmed articles with a title and an id: the last of each article_id by `order`, then the last of each content_hash. Ties go to the larger hash, then id."""
    trimmed = raw.withColumn("title", F.trim("title")).where("title <> '' AND article_id IS NOT NULL AND content_hash IS NOT NULL").withColumn("_order_", order)
    last = [F.desc("_order_"), F.desc("content_hash"), F.desc("article_id")]
    return latest_per_key(latest_per_key(trimmed, ["article_id"], last), ["content_hash"], last).drop("_order_")


def missing_symbols(expected: DataFrame, bars: DataFrame) -> DataFrame:
    """Expected symbols without any close."""
    return expected.join(bars, "symbol", "left").groupBy("symbol").agg(F.count("close").alias("closes")).where("closes = 0").select("symbol")


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Target rows whose key isn't in source, and all of source; NULL keys match each other."""
    match = [target[k].eqNullSafe(source[k]) for k in keys]
    return target.join(source, match, "left_anti").unionByName(source)


def ohlc_inconsistent(bars: DataFrame) -> DataFrame:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return bars.where((h < strict_greatest(o, l, c)) | (l > strict_least(o, h, c)) | c.isNull())


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def nulls(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def not_accepted(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.where(~F.col(column).isin(*values) | F.col(column).isNull())


def stale(df: DataFrame, as_of: Column, days: int = 7, date: str = "date") -> DataFrame:
    """The latest date, if it is over `days` days before as_of."""
    return df.agg(F.max(date).alias("last_date")).where(F.col("last_date") < F.date_sub(as_of, days))


def freshness_status(df: DataFrame, as_of: Column, stamp: str, warn: int = 2, error: int = 7) -> DataFrame:
    age = F.datediff(as_of, F.max(stamp))
    return df.agg(F.max(stamp).alias("last_stamp"), F.when(age > error, "error").when(age > warn, "warn").otherwise("pass").alias("status"))


def coverage(df: DataFrame, key: str, value: str, least: float) -> DataFrame:
    """Keys whose share of non-NULL values is under `least`."""
    return df.groupBy(key).agg(F.avg(F.col(value).isNotNull().cast("double")).alias("coverage")).where(F.col("coverage") < least)


def not_unique(df: DataFrame, column: str) -> DataFrame:
    """Values that stand more than once; NULLs aren't values."""
    return duplicates(df.where(F.col(column).isNotNull()), [column])


def indicator_out_of_range(indicators: DataFrame) -> DataFrame:
    """Rows whose oscillators leave 0..100, whose bands cross, or whose volatilities or volume ratio are negative."""
    outside = lambda c: (F.col(c) < 0) | (F.col(c) > 100)
    broken = [outside("rsi_14"), outside("stochastic_rsi_k"), outside("stochastic_rsi_d"), F.col("bollinger_upper_20d") < F.col("bollinger_lower_20d"), *(F.col(c) < 0 for c in ("volatility_20d", "historical_volatility_20d", "volume_ratio_20d"))]
    return indicators.where(reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in broken]))


def universe_errors(universe: DataFrame, required: Sequence[str], unique: Sequence[str]) -> DataFrame:
    """(column, value, problem): required values that are missing or blank, and ids that stand twice."""
    lacking = [universe.where(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.lit("missing").alias("problem")) for c in required]
    twice = [not_unique(universe, c).select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), F.lit("not unique").alias("problem")) for c in unique]
    return reduce(DataFrame.unionByName, [*lacking, *twice])


def fill_from_close(bars: DataFrame) -> DataFrame:
    """Open, high and low fall back to the close."""
    return bars.withColumns({c: F.coalesce(c, "close") for c in ("open", "high", "low")})


def clean_equity(raw: DataFrame, order: Column) -> DataFrame:
    """As clean_market, but the last row of each (symbol, date) by `order` stays, no symbol may be negative, and dividends and splits fall back to 0."""
    numbers = raw.withColumns({c: finite(F.expr(f"try_cast(`{c}` AS double)")) for c in PRICES}).withColumn("date", F.expr("try_cast(date AS date)"))
    typed = numbers.withColumns({c: F.coalesce(F.expr(f"try_cast(`{c}` AS double)"), F.lit(0.0)) for c in ("dividends", "stock_splits") if c in raw.columns})
    one = latest_per_key(typed.where("symbol IS NOT NULL AND date IS NOT NULL").withColumn("_order_", order), ["symbol", "date"], [F.desc("_order_")]).drop("_order_")
    filled = one.where("close IS NOT NULL").withColumn("adjusted_close", F.coalesce("adjusted_close", "close"))
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    wide = filled.withColumns({"high": F.greatest(*prices), "low": F.least(*prices)})
    return wide.where(F.least(*prices) > 0)


def ticker_validation(universe: DataFrame, bars: DataFrame, least_rows: int = 1) -> DataFrame:
    """For each symbol of the universe its rows with a close, first and last date, and whether that makes it usable."""
    seen = bars.where("close IS NOT NULL").groupBy("symbol").agg(F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return universe.select("symbol").distinct().join(seen, "symbol", "left").fillna(0, ["rows"]).withColumn("valid", F.col("rows") >= least_rows)


def missing_by_year(panel: DataFrame, value: str, key: str = "symbol") -> DataFrame:
    return panel.groupBy(key, F.year("date").alias("year")).agg(F.count_if(F.col(value).isNull()).alias("missing"))


def after(df: DataFrame, as_of: Column, date: str = "date") -> DataFrame:
    """Rows dated after as_of."""
    return df.where(F.col(date) > as_of)
