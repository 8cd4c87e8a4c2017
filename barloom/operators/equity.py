"""Equities: rules run on adjusted prices, buy-and-hold benchmarks, and a portfolio from prices to its curve."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.nullsafe import divide, growth_log
from barloom.operators import index, indicators, metrics, strategies
from barloom.operators.windows import series


def ticker_backtests(bars: DataFrame, rules: Mapping[str, Column], price: str = "adjusted_close", least_rows: int = 60, without_history: Sequence[str] = ("buy_and_hold", "breakout_20d"), baseline: str = "buy_and_hold", fee_bps: float = 10.0, slippage_bps: float = 5.0) -> DataFrame:
    """Metrics of each symbol and rule, with indicators and returns on `price`, and the return beyond the symbol's own baseline.

    Symbols of fewer than least_rows bars are marked insufficient_history for the rules that need a history: their
    metrics are NULL. Rules stand side by side in a bar's row, so one shuffle and one sort by symbol and date serve
    indicators, positions, curves and drawdowns; rows are multiplied by the rules only once they are metrics.
    """
    own = bars.withColumn("close", F.col(price))
    w, n = series("symbol"), range(len(rules))
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    t = strategies.breakout_state(indicators.technical(own))
    t = t.select("symbol", "date", "simple_return", *(c.cast("int").alias(f"signal_{i}") for i, c in enumerate(rules.values())))
    # previous_position is the executed one of the row before, so the signal two rows back
    t = t.withColumns({f"{c}_{i}": F.lag(f"signal_{i}", rows, 0).over(w) for i in n for c, rows in (("executed_position", 1), ("previous_position", 2))})
    t = t.withColumns({f"position_change_{i}": F.abs(F.col(f"executed_position_{i}") - F.col(f"previous_position_{i}")) for i in n})
    t = t.withColumns({f"{c}_cost_{i}": F.col(f"position_change_{i}") * (bps / 1e4) for i in n for c, bps in (("fee", fee_bps), ("slippage", slippage_bps))})
    gain = lambda i: F.col(f"executed_position_{i}") * F.coalesce(F.col("simple_return"), F.lit(0.0))
    t = t.withColumns({f"net_return_{i}": gain(i) - F.col(f"fee_cost_{i}") - F.col(f"slippage_cost_{i}") for i in n})
    total = lambda c: F.exp(F.sum(growth_log(F.col(c))).over(run)) - 1
    t = t.withColumns({f"cumulative_return_{i}": total(f"net_return_{i}") for i in n} | {"cumulative_asset_return": F.coalesce(total("simple_return"), F.lit(0.0))})
    t = t.withColumns({f"drawdown_{i}": F.try_divide(1 + F.col(f"cumulative_return_{i}"), F.max(1 + F.col(f"cumulative_return_{i}")).over(run)) - 1 for i in n})
    every, aggregates = {}, []
    for i in n:
        for m, c in metrics.strategy_aggregates(end=f"_{i}").items():
            every.setdefault(m, []).append(F.col(f"{m}_{i}"))
            aggregates.append(c.alias(f"{m}_{i}"))
    sums = t.groupBy("symbol").agg(*aggregates)
    names = F.array(*(F.lit(r) for r in rules))
    out = sums.select("*", F.posexplode(names).alias("_i_", "strategy_name")).select("symbol", "strategy_name", *(F.array(*cs)[F.col("_i_")].alias(m) for m, cs in every.items()))
    out = metrics.yearly(out).withColumn("rows_available", F.col("days"))
    hold = F.max(F.when(F.col("strategy_name") == baseline, F.col("cumulative_return"))).over(Window.partitionBy("symbol"))
    out = out.withColumn("outperformance_vs_buy_hold", F.col("cumulative_return") - hold)
    lacking = (F.col("rows_available") < least_rows) & ~F.col("strategy_name").isin(*without_history)
    known = ("symbol", "strategy_name", "rows_available")
    return out.select(*known, lacking.alias("insufficient_history"), *(F.when(~lacking, F.col(c)).alias(c) for c in out.columns if c not in known))


def buy_hold_benchmarks(prices: DataFrame, market: Sequence[str] = (), base: float = 100.0) -> DataFrame:
    """Metrics of each symbol rebased on its own first date; the symbols of `market` are indices of the market. Symbols without a positive first price are left out."""
    first = F.first("price").over(series("symbol"))
    levels = index.rebased(prices.where("price IS NOT NULL").withColumn("_first_", first).where("_first_ > 0").drop("_first_"), base)
    out = metrics.series_metrics(levels, "symbol", "level")
    is_market = F.col("symbol").isin(*market) if market else F.lit(False)
    return out.select(F.concat(F.when(is_market, "MARKET_").otherwise("BH_"), "symbol").alias("series_id"), F.when(is_market, "market_index").otherwise("buy_and_hold").alias("benchmark_type"), "*")


def build_portfolio(prices: DataFrame, max_positions: int | None = None, cap: float | None = None, method: str = "equal", unit: str = "quarter", limit: int = 5, lookback: int = 60, least: int = 20, cost_bps: float = 10.0, reserve: float = 0.0, base: float = 100.0) -> DataFrame:
    """The curve of a portfolio: dates on which all positions have a price, weights, rebalancing with costs, cash reserve.

    The first max_positions symbols by name are held; fewer than two raise, and a cap that they cannot meet is left
    off. Inverse volatility starts once its lookback is full. Only a row a date reaches windows without keys.
    """
    chosen = prices.select("symbol").distinct().orderBy("symbol")
    chosen = chosen.limit(max_positions) if max_positions else chosen
    n = chosen.count()
    if n < 2:
        raise ValueError("a portfolio needs two symbols or more")
    panel = index.complete_panel(prices.join(chosen, "symbol", "left_semi"), limit)
    if method == "inverse_volatility":
        start = max(lookback, least)
        days = panel.select("date").distinct().withColumn("_t_", F.row_number().over(Window.orderBy("date"))).where(F.col("_t_") > start).select("date")
        weights = index.target_weights(index.rolling_volatility(panel, lookback, least), method).join(days, "date", "left_semi")
    else:
        weights = index.target_weights(panel, method)
    if cap and cap * n >= 1:
        weights = index.capped(weights, cap)
    curve = index.rebalanced_index(panel.join(weights, ["date", "symbol"]), unit, base, cost_bps, F.col("weight"))
    change = divide(F.col("level"), F.lag("level").over(Window.orderBy("date"))) - 1
    curve = curve.withColumns({"daily_return": change, "portfolio": F.lit("portfolio")})
    return index.cash_reserve(curve, reserve, base).drop("portfolio")
