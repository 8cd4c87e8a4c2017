"""Exponential means over series of any length: chunks of rows as separate tasks.

A kernel needs a bounded number of rows before a chunk, which go to it too. A recursion turns a chunk into an affine map
of the state it begins with; the maps of a series' chunks are composed, and each chunk then runs from its own state.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.indicators import kernel_mean

NAMES = ("macd", "macd_signal", "macd_histogram")


def placed(bars: DataFrame, price: str = "close", stretch_days: int = 366) -> DataFrame:
    """(symbol, date, close, pos): each row's place in its series, from 0. Rows are numbered within stretches of days, and stretches by their counts, so no task sees a series. Dates are unique in a symbol; a NULL price raises."""
    value = F.when(F.col(price).isNull(), F.raise_error(F.lit("a chunked mean needs a price in every row"))).otherwise(F.col(price).cast("double"))
    rows = bars.select("symbol", "date", value.alias("close"), F.floor(F.unix_date("date") / stretch_days).alias("_stretch_"))
    before = F.sum("_n_").over(Window.partitionBy("symbol").orderBy("_stretch_").rowsBetween(Window.unboundedPreceding, -1))
    counts = rows.groupBy("symbol", "_stretch_").agg(F.count("*").alias("_n_")).select("symbol", "_stretch_", F.coalesce(before, F.lit(0)).alias("_before_"))
    numbered = rows.withColumn("_i_", F.row_number().over(Window.partitionBy("symbol", "_stretch_").orderBy("date")))
    return numbered.join(counts, ["symbol", "_stretch_"]).select("symbol", "date", "close", (F.col("_before_") + F.col("_i_") - 1).alias("pos"))


def macd_kernel_scan(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, rows: int = 121, signal_rows: int = 46, price: str = "close", chunk_rows: int = 100_000) -> DataFrame:
    """indicators.macd_kernel() for long series: a chunk gets the rows - 1 + signal_rows - 1 rows before it, which is all its values depend on."""
    overlap = rows + signal_rows - 2
    if chunk_rows < overlap:
        raise ValueError(f"a chunk has at least {overlap} rows")
    names = [f"ema_{fast}", f"ema_{slow}", *NAMES]
    own = F.floor(F.col("pos") / chunk_rows)
    dealt = placed(bars, price).withColumn("part", F.explode(F.when(F.col("pos") % chunk_rows >= chunk_rows - overlap, F.array(own, own + 1)).otherwise(F.array(own))))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x = pdf["close"].to_numpy()
        a, b = kernel_mean(x, fast, rows), kernel_mean(x, slow, rows)
        s = kernel_mean(a - b, signal, signal_rows)
        out = pd.DataFrame({"symbol": pdf["symbol"], "date": pdf["date"], **dict(zip(names, (a, b, a - b, s, a - b - s)))})
        return out[(pdf["pos"] // chunk_rows == key[1]).to_numpy()]

    return dealt.groupBy("symbol", "part").applyInPandas(run, "symbol string, date date, " + ", ".join(f"{n} double" for n in names))


def advance(x: np.ndarray, pos: int, state: tuple[float, float, float], spans: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both means and the signal's over rows that begin at place `pos`, from the state before them. The signal begins with the slow mean's `span`-th row."""
    fast, slow, signal = spans

    def run(values: np.ndarray, span: int, before: float | None) -> np.ndarray:
        head = [] if before is None else [before]
        return pd.Series(np.concatenate([head, values])).ewm(span=span, adjust=False).mean().to_numpy()[len(head) :]

    a, b = (run(x, span, None if pos == 0 else s) for span, s in ((fast, state[0]), (slow, state[1])))
    begin = min(max(0, slow - 1 - pos), len(x))
    g = np.zeros(len(x))
    if begin < len(x):
        g[begin:] = run((a - b)[begin:], signal, None if pos <= slow - 1 else state[2])
    return a, b, g


def macd_recursive_scan(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, price: str = "close", chunk_rows: int = 100_000) -> DataFrame:
    """indicators.macd_recursive() for long series without missing prices.

    A chunk is an affine map of the state (fast mean, slow mean, signal): its value at state zero and its change with
    each part of the state. A series' maps, thirteen numbers a chunk, are composed in one small group; then each chunk
    runs again from the state before it. A series is read twice and is never in one task.
    """
    spans, names = (fast, slow, signal), [f"ema_{fast}", f"ema_{slow}", *NAMES]
    rows = placed(bars, price).withColumn("part", F.floor(F.col("pos") / chunk_rows))
    unit = ((0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0))

    def as_map(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        x, pos = pdf["close"].to_numpy(), int(pdf["pos"].iloc[0])
        ends = [[v[-1] for v in advance(x if i == 0 else np.zeros(len(x)), pos, s, spans)] for i, s in enumerate(unit)]
        return pd.DataFrame({"symbol": [key[0]], "part": [key[1]], "map": [[float(v) for e in ends for v in e]]})

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, states = pdf.sort_values("part"), np.zeros(3), []
        for m in pdf["map"]:
            states.append([float(v) for v in state])
            constant, *columns = np.asarray(m).reshape(4, 3)
            state = constant + np.stack(columns, axis=1) @ state
        return pd.DataFrame({"symbol": pdf["symbol"], "part": pdf["part"], "state": states})

    maps = rows.groupBy("symbol", "part").applyInPandas(as_map, "symbol string, part bigint, map array<double>")
    states = maps.groupBy("symbol").applyInPandas(compose, "symbol string, part bigint, state array<double>")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        pos = pdf["pos"].to_numpy()
        a, b, g = advance(pdf["close"].to_numpy(), int(pos[0]), tuple(pdf["state"].iloc[0]), spans)
        shown = lambda v, first: np.where(pos >= first, v, np.nan)
        values = (shown(a, fast - 1), shown(b, slow - 1), shown(a - b, slow - 1), shown(g, slow + signal - 2), shown(a - b - g, slow + signal - 2))
        return pd.DataFrame({"symbol": pdf["symbol"], "date": pdf["date"], **dict(zip(names, values))})

    out = rows.join(states, ["symbol", "part"]).groupBy("symbol", "part").applyInPandas(run, "symbol string, date date, " + ", ".join(f"{n} double" for n in names))
    return out.withColumns({n: F.nanvl(n, F.lit(None)) for n in names})
