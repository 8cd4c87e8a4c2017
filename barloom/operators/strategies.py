"""Trading rules as columns, and what follows from a signal: position, cost, compounding, drawdown."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.nullsafe import growth_log
from barloom.operators.windows import series

#: Rule thresholds.
K_LEAST, D_MOST, SENTIMENT_LEAST, RISK_MOST, RSI_LEAST, RSI_MOST = 20.0, 80.0, -0.15, 0.75, 30.0, 75.0


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def buy_and_hold() -> Column:
    return F.lit(1)


def moving_average_cross() -> Column:
    return flag(F.col("sma_20") >= F.col("sma_50"))


def moving_average_stoch_rsi() -> Column:
    return flag((F.col("sma_20") >= F.col("sma_50")) & (F.col("stochastic_rsi_k") >= K_LEAST) & (F.col("stochastic_rsi_d") <= D_MOST))


def technical_news_filter(missing_rsi: float | None = 50.0) -> Column:
    """A trend that the news doesn't contradict. Missing news is neutral; a missing RSI counts as missing_rsi, or fails if that is None."""
    news = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    rsi = F.col("rsi_14") if missing_rsi is None else F.coalesce("rsi_14", F.lit(missing_rsi))
    trend = (F.col("close") > F.col("sma_20")) & (F.col("sma_20") >= F.col("sma_50")) & rsi.between(RSI_LEAST, RSI_MOST)
    calm = (news("weighted_sentiment_score") >= SENTIMENT_LEAST) & (news("geopolitical_risk_score") < RISK_MOST) & (news("supply_shock_score") < RISK_MOST)
    return flag(trend & calm)


def breakout_state(bars: DataFrame) -> DataFrame:
    """`breakout`: 1 from a close over previous_high until one under previous_low, with the reason of each row."""
    w = series("symbol")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    enter, leave = F.col("close") > F.col("previous_high"), F.col("close") < F.col("previous_low")
    out = bars.withColumns({"_in_": F.max(F.when(enter, F.col("date"))).over(run), "_out_": F.max(F.when(leave, F.col("date"))).over(run)})
    held = F.col("_in_").isNotNull() & (F.col("_out_").isNull() | (F.col("_in_") > F.col("_out_")))
    out = out.withColumn("breakout", flag(held)).withColumn("_was_", F.lag("breakout", 1, 0).over(w))
    reason = F.when((F.col("_was_") == 1) & leave, "exit_breaks_previous_low").when(enter, "entry_breaks_previous_high").when(F.col("breakout") == 1, "hold_after_breakout").otherwise("flat_no_breakout")
    return out.withColumn("breakout_reason", reason).drop("_in_", "_out_", "_was_")


def rules() -> dict[str, Column]:
    return {"buy_and_hold": buy_and_hold(), "moving_average_cross": moving_average_cross(), "moving_average_stoch_rsi": moving_average_stoch_rsi(), "technical_news_filter": technical_news_filter(), "breakout_20d": F.col("breakout")}


def fan_out(indicators: DataFrame, signals: Mapping[str, Column], keep: Sequence[str]) -> DataFrame:
    """A row for each strategy and bar from one scan: the rules are evaluated side by side and exploded, not unioned."""
    each = F.array(*(F.struct(F.lit(n).alias("strategy_name"), c.cast("int").alias("signal")) for n, c in signals.items()))
    return indicators.select(*keep, F.inline(each))


def normalise(signal: Column, shorts: bool = False) -> Column:
    """Clipped to -1..1; without shorts, negative becomes 0."""
    clipped = F.greatest(F.least(signal, F.lit(1)), F.lit(-1))
    return clipped if shorts else F.greatest(clipped, F.lit(0))


def daily_returns(signals: DataFrame) -> DataFrame:
    """Yesterday's signal earns today's return: executed_position, strategy_return. Partitioned by symbol first, so it reuses the shuffle of the indicators."""
    w = series("symbol", "strategy_name")
    out = signals.withColumn("executed_position", F.lag("signal", 1, 0).over(w))
    return out.withColumn("strategy_return", F.col("executed_position") * F.coalesce(F.col("simple_return"), F.lit(0.0)))


def with_costs(daily: DataFrame, fee_bps: float = 10.0, slippage_bps: float = 5.0) -> DataFrame:
    """previous_position, change, fee and slippage costs, net_return."""
    w = series("symbol", "strategy_name")
    out = daily.withColumn("previous_position", F.lag("executed_position", 1, 0).over(w)).withColumn("position_change", F.abs(F.col("executed_position") - F.col("previous_position")))
    out = out.withColumns({"fee_cost": F.col("position_change") * (fee_bps / 1e4), "slippage_cost": F.col("position_change") * (slippage_bps / 1e4)})
    return out.withColumn("net_return", F.col("strategy_return") - F.col("fee_cost") - F.col("slippage_cost"))


def compounded(daily: DataFrame, keys: Sequence[str] = ("symbol", "strategy_name")) -> DataFrame:
    """cumulative_return of the strategy and cumulative_asset_return of buy and hold, each over the strategy's own rows; cumulative costs."""
    run = series(*keys).rowsBetween(Window.unboundedPreceding, 0)
    total = lambda c: F.exp(F.sum(growth_log(F.col(c))).over(run)) - 1
    return daily.withColumns({"cumulative_return": total("net_return"), "cumulative_asset_return": F.coalesce(total("simple_return"), F.lit(0.0)), "cumulative_cost": F.sum(F.col("fee_cost") + F.col("slippage_cost")).over(run)})


def drawdowns(df: DataFrame, level: Column, keys: Sequence[str] = ("symbol", "strategy_name"), name: str = "drawdown") -> DataFrame:
    """level over its running maximum, less one."""
    out = df.withColumn("_level_", level)
    peak = F.max("_level_").over(series(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(name, F.try_divide(F.col("_level_"), peak) - 1).drop("_level_")


def position_runs(daily: DataFrame, keys: Sequence[str] = ("strategy_name", "symbol"), position: str = "executed_position") -> DataFrame:
    """Runs of consecutive rows in a position: (keys, run, first, last, days)."""
    run = series(*keys).rowsBetween(Window.unboundedPreceding, 0)
    marked = daily.withColumn("run", F.sum(flag(F.col(position) == 0)).over(run)).where(F.col(position) != 0)
    return marked.groupBy(*keys, "run").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("days"))


def trades(daily: DataFrame) -> DataFrame:
    """Rows where the position changed, with the type of trade."""
    kind = F.when((F.col("previous_position") == 0) & (F.col("executed_position") != 0), "open").when((F.col("previous_position") != 0) & (F.col("executed_position") == 0), "close").otherwise("rebalance")
    return daily.where("position_change > 0").select("strategy_name", "symbol", "date", kind.alias("trade_type"), "previous_position", "executed_position", "fee_cost", "slippage_cost")
