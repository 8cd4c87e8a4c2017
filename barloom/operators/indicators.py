"""Technical indicators of bars (symbol, date, open, high, low, close, volume).

Two conventions: `warm=True` gives values from the first row on, as window frames do; `warm=False` waits until a frame
is full. All windows share one partitioning by symbol, so the whole set costs one shuffle and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions.nullsafe import divide, strict_greatest
from barloom.operators.windows import last_rows, rolling_mean, rolling_std, series


def returns(bars: DataFrame, price: str = "close") -> DataFrame:
    """simple_return and log_return against the symbol's previous bar."""
    w = series("symbol")
    out = bars.withColumn("previous_close", F.lag(price).over(w))
    ratio = divide(F.col(price), F.col("previous_close"))
    return out.withColumn("simple_return", ratio - 1).withColumn("log_return", F.when(ratio > 0, F.ln(ratio)))


def moving_averages(bars: DataFrame, lengths: Sequence[int] = (20, 50, 100, 200), warm: bool = True, price: str = "close") -> DataFrame:
    w = series("symbol")
    return bars.withColumns({f"sma_{n}": rolling_mean(F.col(price), w, n, 1 if warm else n) for n in lengths})


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, warm: bool = True, price: str = "close") -> DataFrame:
    w, c = series("symbol"), F.col(price)
    mean, std = rolling_mean(c, w, n, 1 if warm else n), rolling_std(c, w, n, 2 if warm else n)
    return bars.withColumns({f"bollinger_upper_{n}d": mean + k * std, f"bollinger_lower_{n}d": mean - k * std})


def volatility(bars: DataFrame, n: int = 20, days: int = 252, warm: bool = True) -> DataFrame:
    """Of simple_return: over n rows, and scaled to a year."""
    std = rolling_std(F.col("simple_return"), series("symbol"), n, 2 if warm else n)
    return bars.withColumn(f"volatility_{n}d", std).withColumn(f"historical_volatility_{n}d", F.col(f"volatility_{n}d") * F.sqrt(F.lit(float(days))))


def volume_ratio(bars: DataFrame, n: int = 20, warm: bool = True) -> DataFrame:
    return bars.withColumn(f"volume_ratio_{n}d", divide(F.col("volume"), rolling_mean(F.col("volume"), series("symbol"), n, 1 if warm else n)))


def atr(bars: DataFrame, n: int = 14, warm: bool = True) -> DataFrame:
    """Mean true range. Warm, the first bar has none, as it has no previous close; otherwise its own range counts."""
    w = series("symbol")
    parts = (F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_pc_")), F.abs(F.col("low") - F.col("_pc_")))
    out = bars.withColumn("_pc_", F.lag("close").over(w)).withColumn("true_range", strict_greatest(*parts) if warm else F.greatest(*parts))
    return out.withColumn(f"atr_{n}", rolling_mean(F.col("true_range"), w, n, 1 if warm else n)).drop("_pc_")


def rsi(bars: DataFrame, n: int = 14, warm: bool = True, price: str = "close") -> DataFrame:
    """Simple-average RSI: 100 without losses, 50 without any move."""
    w = series("symbol")
    change = bars.withColumn("_d_", F.col(price) - F.lag(price).over(w))
    d, zero = F.col("_d_"), F.lit(0.0)
    up, down = strict_greatest(d, zero), strict_greatest(-d, zero)
    least = 1 if warm else n
    out = change.withColumns({"_up_": rolling_mean(up, w, n, least), "_down_": rolling_mean(down, w, n, least)})
    value = F.when((F.col("_down_") == 0) & (F.col("_up_") == 0), 50.0).when(F.col("_down_") == 0, 100.0).otherwise(100 - 100 / (1 + divide(F.col("_up_"), F.col("_down_"))))
    return out.withColumn(f"rsi_{n}", F.when(F.col("_up_").isNotNull() & F.col("_down_").isNotNull(), value)).drop("_d_", "_up_", "_down_")


def stochastic_rsi(bars: DataFrame, n: int = 14, smooth: int = 3, warm: bool = True) -> DataFrame:
    """K: place of the RSI in its range over n rows, 50 in a flat one; D: mean of K over `smooth` rows. Needs rsi_<n>."""
    w, r = series("symbol"), F.col(f"rsi_{n}")
    frame = last_rows(w, n)
    full = F.count(r).over(frame) >= (1 if warm else n)
    low, high = F.when(full, F.min(r).over(frame)), F.when(full, F.max(r).over(frame))
    out = bars.withColumns({"_low_": low, "_high_": high})
    span = F.col("_high_") - F.col("_low_")
    out = out.withColumn("stochastic_rsi_k", F.when(r.isNotNull() & span.isNotNull(), F.when(span == 0, 50.0).otherwise(100 * divide(r - F.col("_low_"), span))))
    return out.withColumn("stochastic_rsi_d", rolling_mean(F.col("stochastic_rsi_k"), w, smooth, 1 if warm else smooth)).drop("_low_", "_high_")


def kernel_mean(x: np.ndarray, span: int, rows: int) -> np.ndarray:
    """Exponentially weighted mean of the last `rows` values, weights normalised over those there are."""
    weights = (1 - 2 / (span + 1)) ** np.arange(rows)
    return np.convolve(x, weights)[: len(x)] / np.convolve(np.ones(len(x)), weights)[: len(x)]


def macd_kernel(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, rows: int = 121, signal_rows: int = 46, price: str = "close") -> DataFrame:
    """EMAs by a truncated, normalised kernel, and MACD, its signal and histogram. One series fits in a task; a join on row bands is not needed."""
    names = [f"ema_{fast}", f"ema_{slow}", "macd", "macd_signal", "macd_histogram"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        x = pdf["close"].to_numpy(dtype=float)
        a, b = kernel_mean(x, fast, rows), kernel_mean(x, slow, rows)
        s = kernel_mean(a - b, signal, signal_rows)
        return pd.DataFrame({"symbol": pdf["symbol"], "date": pdf["date"], **dict(zip(names, (a, b, a - b, s, a - b - s)))})

    rows_in = bars.select("symbol", "date", F.col(price).cast("double").alias("close"))
    return rows_in.groupBy("symbol").applyInPandas(run, "symbol string, date date, " + ", ".join(f"{n} double" for n in names))


def macd_recursive(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, price: str = "close") -> DataFrame:
    """EMAs by recursion from the first value, shown once `span` values are there, and MACD, signal and histogram."""
    names = [f"ema_{fast}", f"ema_{slow}", "macd", "macd_signal", "macd_histogram"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        mean = lambda x, n: x.ewm(span=n, adjust=False, min_periods=n).mean()
        a, b = mean(pdf["close"], fast), mean(pdf["close"], slow)
        s = mean(a - b, signal)
        return pd.DataFrame({"symbol": pdf["symbol"], "date": pdf["date"], **dict(zip(names, (a, b, a - b, s, a - b - s)))}).astype({n: "float64" for n in names})

    rows_in = bars.select("symbol", "date", F.col(price).cast("double").alias("close"))
    out = rows_in.groupBy("symbol").applyInPandas(run, "symbol string, date date, " + ", ".join(f"{n} double" for n in names))
    return out.withColumns({n: F.nanvl(n, F.lit(None)) for n in names})


def previous_extremes(bars: DataFrame, entry: int = 20, exit_: int = 10, price: str = "close") -> DataFrame:
    """Highest price of the `entry` rows and lowest of the `exit_` rows before each row."""
    w = series("symbol")
    return bars.withColumns({"previous_high": F.max(price).over(w.rowsBetween(-entry, -1)), "previous_low": F.min(price).over(w.rowsBetween(-exit_, -1))})


def technical(bars: DataFrame, warm: bool = True) -> DataFrame:
    """The indicators that window functions give, in one pass over the symbol's partition."""
    out = volume_ratio(volatility(returns(bars), warm=warm), warm=warm)
    return previous_extremes(stochastic_rsi(rsi(atr(bollinger(moving_averages(out, warm=warm), warm=warm), warm=warm), warm=warm), warm=warm))

