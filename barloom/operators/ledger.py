"""The cash-and-position ledger of a strategy, whose state depends on its path: a grouped fold, one series a group."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Account:
    capital: float = 100_000.0
    fee_bps: float = 10.0
    slippage_bps: float = 5.0
    max_exposure: float = 1.0
    shorts: bool = False
    least_trade: float = 1e-12


OUT = "strategy_name string, symbol string, date date, signal int, executed_signal int, action string, quantity double, price double, gross_amount double, fee double, slippage double, cash double, position double, close double, market_value double, equity double, exposure double, realized_return double"


def ledger(signals: DataFrame, account: Account = Account()) -> DataFrame:
    """Daily rows with the day's trade, if any, for rows (strategy_name, symbol, date, close, signal).

    The signal of a row is executed at the next row's close. Purchases are cut to what cash can pay with costs, and
    sales carry the average-cost return that they realise. Rows without a close are left out.
    """
    a = account

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        cash, position, cost, due, rows = a.capital, 0.0, 0.0, 0, []
        for name, symbol, date, close, signal in pdf[["strategy_name", "symbol", "date", "close", "signal"]].itertuples(index=False):
            wanted = max(-1, min(1, due)) if a.shorts else max(0, min(1, due))
            equity = cash + position * close
            change = wanted * a.max_exposure * equity / close - position if (wanted or position) else 0.0
            action = quantity = price = gross = fee = slip = realised = None
            if change > 0:
                paid = close * (1 + a.slippage_bps / 1e4)
                change = min(change, max(cash, 0.0) / (paid * (1 + a.fee_bps / 1e4)))
            if abs(change) > a.least_trade:
                price = close * (1 + (a.slippage_bps if change > 0 else -a.slippage_bps) / 1e4)
                gross, quantity = abs(change) * price, abs(change)
                fee, slip = gross * a.fee_bps / 1e4, abs(change) * abs(price - close)
                action = "BUY" if change > 0 else "SELL"
                if change > 0:
                    cost = (cost * max(position, 0.0) + gross + fee) / (max(position, 0.0) + quantity)
                elif position > a.least_trade and cost > 0:
                    realised = (gross - fee) / (cost * quantity) - 1
                cash -= (gross if change > 0 else -gross) + fee
                position += change
                if abs(position) <= a.least_trade:
                    position = 0.0
            value = position * close
            equity = cash + value
            rows.append((name, symbol, date, signal, wanted, action, quantity, price, gross, fee, slip, cash, position, close, value, equity, value / equity if equity else 0.0, realised))
            due = int(signal)
        return pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    ready = signals.where("close IS NOT NULL").select("strategy_name", "symbol", "date", F.col("close").cast("double").alias("close"), F.coalesce(F.col("signal"), F.lit(0)).cast("int").alias("signal"))
    return ready.groupBy("symbol", "strategy_name").applyInPandas(run, OUT)


def summary(daily: DataFrame, account: Account = Account()) -> DataFrame:
    """Metrics of each ledger, 0 where they aren't defined."""
    from pyspark.sql import Window

    w = Window.partitionBy("symbol", "strategy_name").orderBy("date")
    r = daily.withColumn("r", F.try_divide(F.col("equity"), F.lag("equity").over(w)) - 1).withColumn("dd", F.try_divide(F.col("equity"), F.max("equity").over(w.rowsBetween(Window.unboundedPreceding, 0))) - 1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    out = r.groupBy("strategy_name", "symbol").agg(
        F.max_by("equity", "date").alias("final_equity"), F.min("dd").alias("max_drawdown"), zero(F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("volatility"), zero(F.try_divide(F.avg("r") * F.sqrt(F.lit(252.0)), F.stddev_samp("r"))).alias("sharpe_ratio"),
        F.count("action").alias("trade_count"), zero(F.sum("fee")).alias("total_fees"), zero(F.sum("slippage")).alias("total_slippage"), F.avg(F.abs("exposure")).alias("average_exposure"), zero(F.try_divide(F.sum("gross_amount"), F.avg("equity"))).alias("turnover_ratio"),
        zero(F.avg("realized_return")).alias("average_trade_return"), zero(F.try_divide(F.count_if(F.col("realized_return") > 0), F.count("realized_return"))).alias("trade_win_rate"),
    )
    return out.withColumn("cumulative_return", F.col("final_equity") / account.capital - 1)
