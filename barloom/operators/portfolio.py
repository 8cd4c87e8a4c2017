"""Benchmarks beside strategies: tradable assets, curves of capital, their metrics, and master data in long form."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.nullsafe import divide
from barloom.operators.metrics import DAYS
from barloom.operators.staging import BENCHMARK, typed
from barloom.operators.windows import series

INDEX_ID = "synthetic_commodity_index"


def is_global(index_id: str = INDEX_ID) -> Column:
    """Benchmark rows that stand for the market: no component, or of a kind that says so."""
    return F.col("component_id").isNull() | F.col("benchmark_type").isin("synthetic", "synthetic_index", "global") | F.col("benchmark_id").isin(index_id, "global_commodities")


def index_asset(benchmarks: DataFrame, index_id: str = INDEX_ID, symbol: str = "COMMODITY_INDEX") -> DataFrame:
    """The index as bars: each date's level (the highest, if there are several) as all prices, without a volume."""
    level = benchmarks.where((F.col("benchmark_id") == index_id) & F.col("benchmark_level").isNotNull()).groupBy("date").agg(F.max("benchmark_level").alias("level"))
    return level.select(F.lit(symbol).alias("symbol"), "date", *(F.col("level").alias(c) for c in ("open", "high", "low", "close")), F.lit(None).cast("double").alias("volume"))


def tradable_assets(bars: DataFrame, benchmarks: DataFrame, index_id: str = INDEX_ID) -> DataFrame:
    """Bars of all assets and of the index."""
    return stacked([bars, index_asset(benchmarks, index_id)])


def stacked(frames: Sequence[DataFrame]) -> DataFrame:
    """Rows of all frames by column name; what a frame lacks is NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def benchmark_pick(benchmarks: DataFrame, index_id: str = INDEX_ID) -> DataFrame:
    """One global benchmark row for each date: the index, else one without a component, else another; then by id."""
    rank = F.when(F.col("benchmark_id") == index_id, 1).when(F.col("component_id").isNull(), 2).otherwise(3)
    rest = sorted(set(benchmarks.columns) - {"date", "benchmark_id"})
    w = Window.partitionBy("date").orderBy(rank, "benchmark_id", *rest)
    return benchmarks.where(is_global(index_id)).withColumn("_n_", F.row_number().over(w)).where("_n_ = 1").drop("_n_")


def with_benchmark(daily: DataFrame, curve: DataFrame) -> DataFrame:
    """Daily rows with the benchmark curve (one row a date) of their date, NULL where it has none."""
    return daily.join(curve.select("date", "benchmark_return"), "date", "left")


def restricted(df: DataFrame, dates: DataFrame) -> DataFrame:
    """Rows of df whose date is one of `dates`."""
    return df.join(dates.select("date").distinct(), "date", "left_semi")


def compounded_equity(returns: DataFrame, value: str, keys: Sequence[str], capital: float) -> DataFrame:
    """capital times the running product of 1 + value (NULL as 0)."""
    run = series(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("equity", capital * F.product(1 + F.coalesce(value, F.lit(0.0))).over(run)).withColumn("initial_capital", F.lit(capital))


def portfolio_curves(daily: DataFrame, benchmark: DataFrame, capital: float = 100_000.0) -> DataFrame:
    """(symbol, series_type, series_name, date, equity): strategies net of costs, gross buy and hold, and the benchmark on the symbol's own dates."""
    own = daily.select("symbol", F.lit("strategy").alias("series_type"), F.col("strategy_name").alias("series_name"), "date", F.col("net_return").alias("r"))
    hold = daily.groupBy("symbol", "date").agg(F.max("simple_return").alias("r")).select("symbol", F.lit("buy_hold").alias("series_type"), F.lit("Buy & Hold").alias("series_name"), "date", "r")
    market = hold.select("symbol", "date").join(benchmark.select("date", F.col("daily_return").alias("r")), "date").select("symbol", F.lit("benchmark").alias("series_type"), F.lit("Index").alias("series_name"), "date", "r")
    return compounded_equity(own.unionByName(hold).unionByName(market), "r", ("symbol", "series_type", "series_name"), capital).drop("r")


def curve_metrics(curves: DataFrame, trades: DataFrame, keys: Sequence[str] = ("symbol", "series_type", "series_name")) -> DataFrame:
    """Of each curve: dates, final equity, profit, return on the capital, volatility, Sharpe ratio, drawdown, trades, and the return beyond buy and hold's and the benchmark's.

    The first day's return counts as 0; ratios that are undefined are 0; what is compared with nothing is NULL.
    """
    w = series(*keys)
    r = F.coalesce(divide(F.col("equity"), F.lag("equity").over(w)) - 1, F.lit(0.0))
    each = curves.withColumns({"_r_": r, "_d_": divide(F.col("equity"), F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1})
    year = F.sqrt(F.lit(DAYS))
    out = each.groupBy(*keys).agg(
        F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.max_by("equity", "date").alias("final_equity"), F.max("initial_capital").alias("_capital_"),
        F.coalesce(F.stddev_samp("_r_") * year, F.lit(0.0)).alias("annualized_volatility"), F.coalesce(divide(F.avg("_r_") * year, F.stddev_samp("_r_")), F.lit(0.0)).alias("sharpe_ratio"), F.coalesce(F.min("_d_"), F.lit(0.0)).alias("max_drawdown"),
    )
    out = out.withColumns({"pnl": F.col("final_equity") - F.col("_capital_"), "cumulative_return": divide(F.col("final_equity"), F.col("_capital_")) - 1}).drop("_capital_")
    n = trades.groupBy("symbol", F.col("strategy_name").alias("series_name")).agg(F.count("*").alias("trade_count")).withColumn("series_type", F.lit("strategy"))
    out = out.join(n, ["symbol", "series_type", "series_name"], "left").fillna(0, ["trade_count"])
    of = lambda kind: F.max(F.when(F.col("series_type") == kind, F.col("cumulative_return")))
    best = out.groupBy("symbol").agg(of("buy_hold").alias("_hold_"), of("benchmark").alias("_index_"))
    out = out.join(best, "symbol")
    return out.withColumns({"outperformance_vs_buy_hold": F.col("cumulative_return") - F.col("_hold_"), "outperformance_vs_index": F.col("cumulative_return") - F.col("_index_")}).drop("_hold_", "_index_")


def signals_to_prices(prices: DataFrame, signals: DataFrame) -> DataFrame:
    """Prices with their signals; a day without one is flat, for that reason."""
    return prices.join(signals.select("symbol", "date", "signal", "reason"), ["symbol", "date"], "left").fillna({"signal": 0, "reason": "missing_signal"})


def comparison(index: DataFrame, levels: DataFrame) -> DataFrame:
    """Levels of the index and of each asset on the dates that both have, in long form."""
    both = levels.join(index.select("date"), "date", "left_semi").select("date", "symbol", "level")
    return both.unionByName(index.join(levels.select("date").distinct(), "date", "left_semi").select("date", F.lit("INDEX").alias("symbol"), "level"))


def benchmark_rows(levels: DataFrame, index: DataFrame, prefix: str = "buy_hold_") -> DataFrame:
    """Asset and index levels shaped as stored benchmarks: ids, types, component, level, daily return and drawdown."""
    hold = levels.select("date", F.concat(F.lit(prefix), F.lower("symbol")).alias("benchmark_id"), F.lit("buy_and_hold").alias("benchmark_type"), F.col("symbol").alias("component_id"), "level")
    whole = index.select("date", F.lit(INDEX_ID).alias("benchmark_id"), F.lit("synthetic_index").alias("benchmark_type"), F.lit(None).cast("string").alias("component_id"), "level")
    w = series("benchmark_id")
    change = divide(F.col("level"), F.lag("level").over(w)) - 1
    fall = divide(F.col("level"), F.max("level").over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1
    return hold.unionByName(whole).withColumns({"daily_return": change, "drawdown": fall}).withColumnRenamed("level", "benchmark_level")


def stored_benchmarks(master: DataFrame, source: str, index_id: str = INDEX_ID, prefix: str = "buy_hold") -> DataFrame:
    """Rows of the stored benchmark table, two for each row of the master data: the asset held, and the index with the asset's weights.

    Needs symbol, date, price, asset_level, asset_return, index_level; index_return, index_drawdown, actual_weight,
    target_weight, rebalance_executed, name, category and priority are taken where they are there. Both rows come from one scan.
    """
    have = lambda c, t="double": (F.col(c) if c in master.columns else F.lit(None)).cast(t)
    name = F.coalesce(have("name", "string"), F.col("symbol"))
    none = F.lit(None)

    def row(id_: Column, kind: str, title: Column, level: str, change: Column, *index_only: Column) -> Column:
        fall, actual, target, executed = index_only or (none.cast("double"),) * 3 + (none.cast("boolean"),)
        return F.struct(id_.alias("benchmark_id"), F.lit(kind).alias("benchmark_type"), title.alias("benchmark_name"), have(level).alias("benchmark_level"), change.alias("daily_return"), fall.alias("drawdown"), actual.alias("actual_weight"), target.alias("target_weight"), executed.alias("rebalance_executed"))

    held = row(F.concat(F.lit(f"{prefix}_"), F.lower("symbol")), "buy_and_hold", F.concat(F.lit("Buy & Hold "), name), "asset_level", have("asset_return"))
    whole = row(F.lit(index_id), "synthetic_index", F.lit(index_id), "index_level", have("index_return"), have("index_drawdown"), have("actual_weight"), have("target_weight"), have("rebalance_executed", "boolean"))
    rows = master.select("date", F.col("symbol").alias("component_id"), F.col("symbol").alias("component_symbol"), name.alias("component_name"), have("category", "string").alias("category"), have("priority", "string").alias("priority"), F.col("price").alias("close_price"), F.lit(source).alias("source"), F.inline(F.array(held, whole)))
    return typed(rows, BENCHMARK)


def external_benchmark(prices: DataFrame, benchmark_id: str, symbol: str, name: str, category: str, source: str, kind: str = "global", base: float = 100.0) -> DataFrame:
    """A benchmark from outside (date, close; one row a date) as rows of the stored table, rebased to `base` on its first date with a price.

    Rows without a date or price are left out; a first price of 0 gives NULL levels. One series has few rows, which is
    what makes windows without keys affordable.
    """
    some = prices.where("date IS NOT NULL AND close IS NOT NULL").select("date", F.col("close").cast("double").alias("close_price"), F.lit(benchmark_id).alias("benchmark_id"))
    w = series("benchmark_id")
    rebased = some.withColumn("benchmark_level", divide(F.col("close_price"), F.first("close_price").over(w)) * base)
    falls = divide(F.col("benchmark_level"), F.max("benchmark_level").over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1
    rows = rebased.withColumns({"daily_return": divide(F.col("benchmark_level"), F.lag("benchmark_level").over(w)) - 1, "drawdown": falls})
    fixed = {"benchmark_type": kind, "benchmark_name": name, "component_id": "GLOBAL", "component_symbol": symbol, "component_name": name, "category": category, "source": source}
    return typed(rows.withColumns({c: F.lit(v) for c, v in fixed.items()}), BENCHMARK)


def master(levels: DataFrame, prices: DataFrame, index: DataFrame, dimension: DataFrame) -> DataFrame:
    """Prices with the asset's level and return, the index' level and the dimension's attributes; NULL where there are none."""
    own = levels.select("symbol", "date", F.col("level").alias("asset_level")).withColumn("asset_return", divide(F.col("asset_level"), F.lag("asset_level").over(series("symbol"))) - 1)
    return prices.select("symbol", "date", "price").join(own, ["symbol", "date"], "left").join(index.select("date", F.col("level").alias("index_level")), "date", "left").join(dimension, "symbol", "left")


def asset_metadata(panel: DataFrame, filled: str, dimension: DataFrame) -> DataFrame:
    """Of each asset: rows, dates, missing and non-positive prices, carried values, and its attributes."""
    out = panel.groupBy("symbol").agg(F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count_if(F.col("price").isNull()).alias("missing"), F.count_if(F.col("price") <= 0).alias("non_positive"), F.count_if(F.col(filled)).alias("carried"))
    return out.join(dimension, "symbol", "left")
