"""Strategy metrics, benchmark curves, validation periods and rankings."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.nullsafe import divide, growth_log
from barloom.operators.strategies import drawdowns, flag
from barloom.operators.windows import latest_per_key

DAYS = 252.0


def sharpe(r: Column, days: float = DAYS) -> Column:
    return divide(F.avg(r) * days, F.stddev_samp(r) * F.sqrt(F.lit(days)))


def sortino(r: Column, days: float = DAYS) -> Column:
    return divide(F.avg(r) * days, F.stddev_samp(F.when(r < 0, r)) * F.sqrt(F.lit(days)))


def strategy_metrics(daily: DataFrame, keys: Sequence[str] = ("strategy_name", "symbol"), benchmark_stat: str = "last", also: Sequence[Column] = ()) -> DataFrame:
    """One row for each key: dates, returns, volatility, ratios, drawdown, win rate, profit factor, exposure.

    Needs compounded() columns. Ratios with a zero divisor are NULL. benchmark_stat "last" takes the final value of
    the asset's curve, "peak" its highest. Further aggregates are taken in the same pass over the rows.
    """
    order = [k for k in ("symbol", "strategy_name", *keys) if k in keys]
    down = drawdowns(daily, 1 + F.col("cumulative_return"), sorted(set(order), key=order.index))
    return yearly(down.groupBy(*keys).agg(*(c.alias(n) for n, c in strategy_aggregates(benchmark_stat, costs=False).items()), *also))


def strategy_aggregates(benchmark_stat: str = "last", end: str = "", costs: bool = True) -> dict[str, Column]:
    """The metrics of daily rows with drawdowns, as aggregates by name; `end` is that of the columns of one rule, where rules stand side by side."""
    of = lambda c: F.col(c + end)
    r = of("net_return")
    held = F.max_by("cumulative_asset_return", "date") if benchmark_stat == "last" else F.max("cumulative_asset_return")
    out = {
        "first_date": F.min("date"), "last_date": F.max("date"), "days": F.count("*"), "cumulative_return": F.max_by(of("cumulative_return"), "date"), "buy_hold_cumulative_return": held,
        "annualized_volatility": F.stddev_samp(r) * F.sqrt(F.lit(DAYS)), "sharpe_ratio": sharpe(r), "sortino_ratio": sortino(r), "max_drawdown": F.min(of("drawdown")),
        "win_rate": divide(F.count_if(r > 0), F.count_if(r != 0)), "profit_factor": divide(F.sum(F.when(r > 0, r).otherwise(0.0)), -F.sum(F.when(r < 0, r))), "exposure": F.avg(F.abs(of("executed_position")).cast("double")),
    }
    return out | (dict(zip(("trade_count", "total_fees", "total_slippage"), cost_totals(end))) if costs else {})


def yearly(out: DataFrame) -> DataFrame:
    """With what follows from the aggregates: annualized_return and calmar_ratio."""
    out = out.withColumn("annualized_return", F.pow(F.greatest(1 + F.col("cumulative_return"), F.lit(1e-6)), F.lit(DAYS) / F.col("days")) - 1)
    return out.withColumn("calmar_ratio", divide(F.col("annualized_return"), F.abs("max_drawdown")))


TRADED = "position_change > 0"


def cost_totals(end: str = "") -> list[Column]:
    """Number of trades and their costs, as aggregates over daily rows; 0 without trades."""
    traded = F.col(f"position_change{end}") > 0
    total = lambda c: F.coalesce(F.sum(F.when(traded, F.col(c + end))), F.lit(0.0))
    return [F.count_if(traded).alias("trade_count"), total("fee_cost").alias("total_fees"), total("slippage_cost").alias("total_slippage")]


def trade_costs(daily: DataFrame, keys: Sequence[str] = ("strategy_name", "symbol")) -> DataFrame:
    """Trades and costs of the keys that traded."""
    return daily.where(TRADED).groupBy(*keys).agg(*cost_totals())


def full_metrics(daily: DataFrame, keys: Sequence[str] = ("strategy_name", "symbol"), benchmark_stat: str = "last") -> DataFrame:
    """Metrics with trade costs, mean run length and outperformance, in one aggregation of the daily rows.

    Runs of days in a position are as many as days that enter one, so their mean length needs no rows of runs. It is
    NULL for keys that never held one; keys without trades count 0.
    """
    held = F.col("executed_position") != 0
    length = divide(F.count_if(held), F.count_if(held & (F.col("previous_position") == 0))).alias("average_position_days")
    out = strategy_metrics(daily, keys, benchmark_stat, (*cost_totals(), length))
    return out.withColumn("outperformance", F.col("cumulative_return") - F.col("buy_hold_cumulative_return"))


def market_metrics(daily: DataFrame, curve: DataFrame, keys: Sequence[str] = ("strategy_name", "symbol"), benchmark_stat: str = "last", market_stat: str = "peak") -> DataFrame:
    """full_metrics() beside the global benchmark: its cumulative return on the strategy's own dates, and what the strategy has over it.

    `curve` has one row a date (date, benchmark_return), as benchmark_curve() returns it. "peak" takes the curve's highest
    value on those dates, "last" the one on the last of them that has any; without any it is NULL and counts as 0.
    Costs are also given as one rate, and keys that never held a position have a mean run length of 0. Still one
    aggregation of the daily rows.
    """
    market = F.max("benchmark_return") if market_stat == "peak" else F.max_by("benchmark_return", F.when(F.col("benchmark_return").isNotNull(), F.col("date")))
    held = F.col("executed_position") != 0
    length = F.coalesce(divide(F.count_if(held), F.count_if(held & (F.col("previous_position") == 0))), F.lit(0.0)).alias("average_position_days")
    rows = daily.join(curve.select("date", "benchmark_return"), "date", "left")
    out = strategy_metrics(rows, keys, benchmark_stat, (*cost_totals(), length, market.alias("global_benchmark_cumulative_return")))
    over = {"outperformance": "buy_hold_cumulative_return", "outperformance_vs_global_benchmark": "global_benchmark_cumulative_return"}
    return out.withColumns({"total_cost_rate": F.col("total_fees") + F.col("total_slippage"), **{n: F.col("cumulative_return") - F.coalesce(c, F.lit(0.0)) for n, c in over.items()}})


def equity_scalars(rows: DataFrame, keys: Sequence[str], equity: str = "equity", trade_return: str | None = None, order: str = "date", days: float = DAYS, risk_free: float = 0.0) -> DataFrame:
    """By key, of a curve of equity: returns, volatility, ratios, drawdown, share of winning and profit factor, where what is undefined counts as 0.

    The other convention beside strategy_metrics(), which has NULL there. Daily returns are the curve's changes, 0 on the
    first day and where the value before is missing or 0. Winning and profit are judged on `trade_return` where it isn't
    NULL, by default on the daily returns; all of them count, also those of 0, and gains without any loss are infinite.
    Rows without an equity are left out; of equal dates all columns decide the order.
    """
    some = rows.where(F.col(equity).isNotNull())
    w = Window.partitionBy(*keys).orderBy(order, *(F.col(c) for c in sorted(set(rows.columns) - {*keys, order})))
    e = F.col(equity).cast("double")
    at = some.select(*keys, F.row_number().over(w).alias("_i_"), e.alias("_e_"), F.coalesce(divide(e, F.lag(e).over(w)) - 1, F.lit(0.0)).alias("_r_"), divide(e, F.max(e).over(w.rowsBetween(Window.unboundedPreceding, 0))).alias("_share_"), *([F.col(trade_return).alias("_t_")] if trade_return else []))
    r, t = F.col("_r_"), F.col("_t_" if trade_return else "_r_")
    year, falls = F.sqrt(F.lit(days)), F.when(r < 0, r)
    sums = at.groupBy(*keys).agg(
        F.count("*").alias("days"), F.min_by("_e_", "_i_").alias("_first_"), F.max_by("_e_", "_i_").alias("_last_"), (F.avg(r) * days - risk_free).alias("_excess_"), (F.stddev_samp(r) * year).alias("_vol_"), (F.stddev_samp(falls) * year).alias("_down_"),
        F.coalesce(F.min("_share_") - 1, F.lit(0.0)).alias("max_drawdown"), F.coalesce(F.avg((t > 0).cast("double")), F.lit(0.0)).alias("win_rate"), F.coalesce(F.sum(F.when(t > 0, t)), F.lit(0.0)).alias("_won_"), F.coalesce(-F.sum(F.when(t < 0, t)), F.lit(0.0)).alias("_lost_"),
    )
    ratio = lambda a, b: F.coalesce(divide(F.col(a), F.col(b)), F.lit(0.0))
    growth = divide(F.col("_last_"), F.col("_first_"))
    yearly = F.when((F.col("days") < 2) | (F.col("_first_") <= 0), 0.0).otherwise(F.pow(growth, F.lit(days) / F.col("days")) - 1)
    out = sums.withColumns({"cumulative_return": F.coalesce(growth - 1, F.lit(0.0)), "annualized_return": yearly, "annualized_volatility": F.coalesce("_vol_", F.lit(0.0)), "sharpe_ratio": ratio("_excess_", "_vol_"), "sortino_ratio": ratio("_excess_", "_down_")})
    out = out.withColumns({"calmar_ratio": F.coalesce(divide(F.col("annualized_return"), F.abs("max_drawdown")), F.lit(0.0)), "profit_factor": F.when(F.col("_lost_") == 0, F.when(F.col("_won_") > 0, F.lit(float("inf"))).otherwise(0.0)).otherwise(F.col("_won_") / F.col("_lost_"))})
    return out.drop("_first_", "_last_", "_excess_", "_vol_", "_down_", "_won_", "_lost_")


OVERVIEW = ("news_volume", "news_pressure_score", "weighted_sentiment_score", "news_acceleration", "geopolitical_risk_score", "supply_shock_score", "weather_risk_score")


def overview(signals: DataFrame, metrics: DataFrame) -> DataFrame:
    """A row a symbol: its latest signal with the news of that day, and the metrics of the strategy that gave it; of equal dates the first strategy by name."""
    first = latest_per_key(signals.select("symbol", "date", "strategy_name", "close", "signal", *OVERVIEW), ["symbol"], [F.desc("date"), F.asc("strategy_name")])
    named = first.withColumnsRenamed({"date": "latest_date", "close": "latest_close", "signal": "latest_signal"})
    return named.join(metrics.drop("first_date", "last_date", "days"), ["symbol", "strategy_name"], "left")


def benchmark_daily(daily: DataFrame, condition: Column) -> DataFrame:
    """Mean return by date over the rows that count as the global benchmark."""
    return daily.where(condition).groupBy("date").agg(F.avg("daily_return").alias("daily_return"))


def benchmark_curve(by_date: DataFrame) -> DataFrame:
    """Compounded return by date. Takes one row a date, which is what makes a window without keys affordable."""
    run = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return by_date.withColumn("benchmark_return", F.exp(F.sum(growth_log(F.col("daily_return"))).over(run)) - 1)


def assign_period(date: Column, periods: Sequence[tuple[str, str, str]]) -> Column:
    """Name of the last period (name, first day, last day) that holds the date, else out_of_scope."""
    out = F.lit("out_of_scope")
    for name, first, last in periods:
        out = F.when(date.between(F.lit(first).cast("date"), F.lit(last).cast("date")), name).otherwise(out)
    return out


def with_periods(daily: DataFrame, periods: DataFrame, most: int = 10_000) -> DataFrame:
    """Daily rows with period, purpose and optimisable of the last period (by `position`) that holds their date; out_of_scope, NULL and false outside.

    `periods` has (position, period, purpose, optimisable, first, last), the last day NULL for an open one. The dates of
    the rows, not the rows, meet the periods by range; a table of over `most` periods raises, so sending it to all tasks
    is bounded.
    """
    n = periods.count()
    if n > most:
        raise ValueError(f"{n} periods; at most {most} are sent to the tasks")
    within = F.col("date").between(F.col("first"), F.coalesce("last", F.lit("9999-12-31").cast("date")))
    found = daily.select("date").distinct().join(F.broadcast(periods), within).groupBy("date").agg(F.max_by(F.struct("period", "purpose", "optimisable"), "position").alias("_p_"))
    out = daily.join(found, "date", "left")
    return out.withColumns({"period": F.coalesce("_p_.period", F.lit("out_of_scope")), "purpose": F.col("_p_.purpose"), "optimisable": F.coalesce("_p_.optimisable", F.lit(False))}).drop("_p_")


def percent_rank_score(metrics: DataFrame, within: Sequence[str]) -> DataFrame:
    """0.35 of each return and Sharpe rank, 0.20 of the drawdown's, less 0.10 of the turnover's; NULLs rank first."""
    rank = lambda c: F.percent_rank().over(Window.partitionBy(*within).orderBy(F.col(c).asc_nulls_first()))
    return metrics.withColumn("score", 0.35 * rank("cumulative_return") + 0.35 * rank("sharpe_ratio") + 0.20 * rank("max_drawdown") - 0.10 * rank("trade_count"))


def average_rank_score(metrics: DataFrame, within: Sequence[str]) -> DataFrame:
    """As percent_rank_score with mean ranks over the count of non-NULL values."""

    def rank(c: str) -> Column:
        by = Window.partitionBy(*within)
        ties = F.count(c).over(Window.partitionBy(*within, c))
        place = F.rank().over(by.orderBy(F.col(c).asc_nulls_last())) + (ties - 1) / 2
        return F.when(F.col(c).isNotNull(), place / F.count(c).over(by))

    return metrics.withColumn("rank_score", 0.35 * rank("cumulative_return") + 0.35 * rank("sharpe_ratio") + 0.20 * rank("max_drawdown") - 0.10 * rank("trade_count"))


def filter_contribution(metrics: DataFrame, with_filter: str, without: str, keys: Sequence[str]) -> DataFrame:
    """What a filter adds to a rule, by conditional aggregation: one scan instead of a self-join. Keys that lack either rule are left out.

    It adds value if the return is higher and neither the Sharpe ratio nor the drawdown is worse; NULL where one is unknown.
    """
    of = lambda c, s: F.max(F.when(F.col("strategy_name") == s, F.col(c)))
    out = metrics.where(F.col("strategy_name").isin(with_filter, without)).groupBy(*keys).agg(F.count_distinct("strategy_name").alias("n"), *(e.alias(f"{c}_{k}") for c in ("cumulative_return", "sharpe_ratio", "max_drawdown") for k, e in (("with", of(c, with_filter)), ("without", of(c, without)))))
    out = out.where("n = 2").drop("n")
    delta = lambda c: F.round(F.col(f"{c}_with") - F.col(f"{c}_without"), 9)  # noqa: E731  equal ones stay equal in any order of addition
    out = out.withColumns({"return_delta": delta("cumulative_return"), "sharpe_delta": delta("sharpe_ratio"), "drawdown_delta": delta("max_drawdown")})
    return out.withColumn("adds_value", (F.col("return_delta") > 0) & (F.col("sharpe_delta") >= 0) & (F.col("drawdown_delta") >= 0))


def summarise(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct symbols, mean, median and least return, and the share of positive ones."""
    r = F.col("cumulative_return")
    return metrics.groupBy(*keys).agg(F.count_distinct("symbol").alias("symbols"), F.avg(r).alias("mean_return"), F.median(r).alias("median_return"), F.min(r).alias("min_return"), F.count_if(r > 0).alias("positive"), divide(F.count_if(r > 0), F.count("*")).alias("positive_rate"))


def strategy_comparison(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("strategy_name").agg(F.avg("cumulative_return").alias("mean_return"), F.avg("sharpe_ratio").alias("mean_sharpe"), F.avg("max_drawdown").alias("mean_drawdown"), F.avg("outperformance").alias("mean_outperformance"), F.count_distinct("symbol").alias("assets"), F.sum("trade_count").alias("trades"))


def series_metrics(levels: DataFrame, key: str, level: str, risk_free: float = 0.0) -> DataFrame:
    """Of each series of levels: dates, count, total return, CAGR by calendar days, volatility, Sharpe, drawdown; NULL under two rows."""
    w = Window.partitionBy(key).orderBy("date")
    down = drawdowns(levels.withColumn("_r_", F.try_divide(F.col(level), F.lag(level).over(w)) - 1), F.col(level), [key], "_dd_")
    a = down.groupBy(key).agg(F.min("date").alias("start_date"), F.max("date").alias("end_date"), F.count(level).alias("n"), F.min_by(level, "date").alias("_a_"), F.max_by(level, "date").alias("_z_"), F.stddev_samp("_r_").alias("_s_"), F.avg("_r_").alias("_m_"), F.min("_dd_").alias("max_drawdown"), F.count_if(F.col(level) <= 0).alias("non_positive"))
    ratio, years = F.try_divide(F.col("_z_"), F.col("_a_")), F.datediff("end_date", "start_date") / 365.25
    if_two = lambda c: F.when(F.col("n") >= 2, c)
    daily_rf = (1 + risk_free) ** (1 / DAYS) - 1
    return a.select(key, "start_date", "end_date", "n", if_two(ratio - 1).alias("total_return"), if_two(F.pow(ratio, F.try_divide(F.lit(1.0), years)) - 1).alias("cagr"), if_two(F.col("_s_") * F.sqrt(F.lit(DAYS))).alias("volatility"), if_two(divide((F.col("_m_") - daily_rf) * F.sqrt(F.lit(DAYS)), F.col("_s_"))).alias("sharpe"), if_two(F.col("max_drawdown")).alias("max_drawdown"), "non_positive")


def pair_sums(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """Over the rows where both have a value, for each column of x and of y: count, sums, squares and products, as matrix products."""
    there = [np.isfinite(v).astype(np.float64) for v in (x, y)]
    x, y = (np.where(m > 0, v, 0.0) for v, m in zip((x, y), there))
    mx, my = there
    return mx.T @ my, x.T @ my, mx.T @ y, (x * x).T @ my, mx.T @ (y * y), x.T @ y


def correlations(returns: DataFrame, value: str = "simple_return", block_symbols: int = 512, block_dates: int = 2048) -> DataFrame:
    """Pairwise-complete correlation of symbols, long form: symbol_a <= symbol_b, correlation, n (common dates, pairs without any left out).

    Symbols are dealt into blocks of about block_symbols by hash, dates into stretches of block_dates calendar days.
    Each pair of blocks in a stretch is one task's matrix products; its sums for each pair of symbols are added up over
    the stretches. No row stands for a pair on a date: the rows are the result's, times the stretches. Values are taken
    less the symbol's mean, which changes no correlation and keeps the sums exact. NULL and non-finite values and NULL
    dates are missing; a symbol has at most one row a date. NULL where a deviation is 0 or n is under 2.
    """
    finite = returns.select("symbol", "date", F.col(value).cast("double").alias("v")).where("date IS NOT NULL AND symbol IS NOT NULL AND v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')")
    means = finite.groupBy("symbol").agg(F.avg("v").alias("mean"))
    blocks = means.agg(F.ceil(F.count("*") / block_symbols).cast("long").alias("blocks"))
    universe = means.crossJoin(F.broadcast(blocks)).select("symbol", "mean", F.pmod(F.xxhash64("symbol"), "blocks").alias("block"), "blocks")  # one row
    rows = finite.join(universe, "symbol").select("symbol", F.unix_date("date").alias("day"), (F.col("v") - F.col("mean")).alias("v"), "block", "blocks", F.floor(F.unix_date("date") / block_dates).alias("stretch"))
    # a row goes to each block of the other side: as the left one if its block is not the greater
    dealt = rows.select("symbol", "day", "v", "stretch", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    task = F.struct(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "stretch")
    sums = [f"s{i}" for i in range(6)]

    def multiply(t: pa.Table) -> pa.Table:
        symbol, day = (t.column(c).combine_chunks().dictionary_encode() for c in ("symbol", "day"))
        names, of, at = symbol.dictionary, symbol.indices.to_numpy(), day.indices.to_numpy()
        grid = np.full((len(day.dictionary), len(names)), np.nan)
        grid[at, of] = np.asarray(t.column("v"))
        block = np.zeros(len(names), dtype=np.int64)
        block[of] = np.asarray(t.column("block"))
        side = [np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())]
        same = block.min() == block.max()
        if same and t.column("task")[0].as_py()["a"] != t.column("task")[0].as_py()["b"]:
            side[1] = side[1][:0]  # the other block has no row in this stretch
        found = pair_sums(grid[:, side[0]], grid[:, side[1]])
        i, j = np.nonzero(found[0] > 0)
        if same:
            i, j = i[i <= j], j[i <= j]
        first, second = names.take(pa.array(side[0][i])), names.take(pa.array(side[1][j]))
        return pa.table({"x": first, "y": second, **{s: f[i, j] for s, f in zip(sums, found)}})

    products = dealt.withColumn("task", task).groupBy("task").applyInArrow(multiply, "x string, y string, " + ", ".join(f"{s} double" for s in sums))
    ordered = F.col("x") <= F.col("y")
    straight = {"symbol_a": F.least("x", "y"), "symbol_b": F.greatest("x", "y"), "n": F.col("s0"), "a": F.when(ordered, F.col("s1")).otherwise(F.col("s2")), "b": F.when(ordered, F.col("s2")).otherwise(F.col("s1")), "aa": F.when(ordered, F.col("s3")).otherwise(F.col("s4")), "bb": F.when(ordered, F.col("s4")).otherwise(F.col("s3")), "ab": F.col("s5")}
    whole = products.select(*(c.alias(n) for n, c in straight.items())).groupBy("symbol_a", "symbol_b").agg(*(F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab")))
    spread = lambda s, q: F.greatest(F.col(q) - F.col(s) * F.col(s) / F.col("n"), F.lit(0.0))
    across = F.col("ab") - F.col("a") * F.col("b") / F.col("n")
    flat = lambda s, q: spread(s, q) <= 1e-14 * F.col(q)  # noqa: E731  nothing but rounding is left
    r = F.when((F.col("n") > 1) & ~flat("a", "aa") & ~flat("b", "bb"), F.greatest(F.least(across / F.sqrt(spread("a", "aa") * spread("b", "bb")), F.lit(1.0)), F.lit(-1.0)))
    return whole.select("symbol_a", "symbol_b", r.alias("correlation"), F.col("n").cast("long").alias("n"))


def return_distribution(returns: DataFrame, value: str = "simple_return") -> DataFrame:
    p = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    out = returns.groupBy("symbol").agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.percentile(value, F.array(*map(F.lit, p))).alias("_p_"))
    return out.select("symbol", "n", "mean", "std", "min", "max", *(F.col("_p_")[i].alias(f"p{round(q * 100):02d}") for i, q in enumerate(p)))


def monthly_seasonality(bars: DataFrame) -> DataFrame:
    """Returns between month-end closes, by symbol and calendar month."""
    ends = bars.groupBy("symbol", F.trunc("date", "month").alias("m")).agg(F.max_by("close", "date").alias("close"))
    r = ends.withColumn("r", F.try_divide(F.col("close"), F.lag("close").over(Window.partitionBy("symbol").orderBy("m"))) - 1).where("r IS NOT NULL")
    return r.groupBy("symbol", F.month("m").alias("month")).agg(F.avg("r").alias("mean_return"), F.median("r").alias("median_return"), divide(F.count_if(F.col("r") > 0), F.count("*")).alias("positive_rate"), F.count("*").alias("n"))


def annual_returns(bars: DataFrame) -> DataFrame:
    """Returns between year-end closes; the first year counts from its first close."""
    ends = bars.groupBy("symbol", F.year("date").alias("year")).agg(F.max_by("close", "date").alias("last"), F.min_by("close", "date").alias("first"))
    before = F.coalesce(F.lag("last").over(Window.partitionBy("symbol").orderBy("year")), F.col("first"))
    return ends.select("symbol", "year", (F.try_divide(F.col("last"), before) - 1).alias("annual_return"))


def rolling_relative(levels: DataFrame, index: DataFrame, n: int = 252) -> DataFrame:
    """n-row return of each symbol less the index's."""
    change = lambda df, keys: F.try_divide(F.col("level"), F.lag("level", n).over(Window.partitionBy(*keys).orderBy("date"))) - 1
    own = levels.select("symbol", "date", change(levels, ["symbol"]).alias("own"))
    of = index.select("date", (F.try_divide(F.col("level"), F.lag("level", n).over(Window.orderBy("date"))) - 1).alias("of_index"))
    return own.join(of, "date").select("symbol", "date", (F.col("own") - F.col("of_index")).alias("relative_return")).where("relative_return IS NOT NULL")


def ranking(df: DataFrame, by: Sequence[str], ties: Sequence[str], limit: int | None = None) -> DataFrame:
    """Rows by some columns descending, NULLs last, ties by others ascending; the first `limit` of them if given."""
    out = df.orderBy(*(F.desc_nulls_last(c) for c in by), *(F.asc(c) for c in ties))
    return out.limit(limit) if limit is not None else out


def best_by(metrics: DataFrame, key: str, column: str, name: str = "strategy_name") -> DataFrame:
    """The name with the highest value for each key, the least name among equals; NULL values never win."""
    top = F.min_by(name, F.struct((-F.col(column)).alias("v"), F.col(name).alias("n")))
    return metrics.where(F.col(column).isNotNull()).groupBy(key).agg(top.alias(f"best_{column}"))
