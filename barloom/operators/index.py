"""Rebased levels, rebalanced indices and portfolios on long panels (date, symbol, price)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.windows import fill_forward, last_rows
from barloom.sources.scratch import stored


def complete_panel(prices: DataFrame, limit: int = 5) -> DataFrame:
    """The grid of all dates and symbols, prices carried at most `limit` rows, and only dates on which every symbol has one.

    Dates and symbols are those of the panel: a grid of its calendar and its universe, not a product of its rows.
    """
    symbols = prices.select("symbol").distinct().agg(F.collect_set("symbol").alias("s"))
    days = prices.select("date").distinct()
    grid = days.crossJoin(F.broadcast(symbols)).select("date", F.explode("s").alias("symbol"))  # one row: the universe
    filled = fill_forward(grid.join(prices.select("date", "symbol", "price"), ["date", "symbol"], "left"), "price", ["symbol"], limit)
    by = Window.partitionBy("date")
    whole = filled.withColumns({"_have_": F.count("price").over(by), "_all_": F.count("*").over(by)}).where("_have_ = _all_")
    return whole.drop("_have_", "_all_")


def rebased(prices: DataFrame, base: float = 100.0) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date")
    return prices.withColumn("level", base * F.col("price") / F.first("price").over(w))


def rolling_volatility(prices: DataFrame, n: int = 60, least: int = 20) -> DataFrame:
    w = Window.partitionBy("symbol").orderBy("date")
    r = prices.withColumn("_r_", F.try_divide(F.col("price"), F.lag("price").over(w)) - 1)
    frame = last_rows(w, n)
    return r.withColumn("volatility", F.when(F.count("_r_").over(frame) >= least, F.stddev_samp("_r_").over(frame))).drop("_r_")


def rebalance_flags(days: DataFrame, unit: str = "quarter") -> DataFrame:
    """One row a date: whether it is the first or begins a new month, quarter or year."""
    before = F.lag(F.trunc("date", unit)).over(Window.orderBy("date"))
    return days.select("date").distinct().withColumn("_b_", before).select("date", (F.col("_b_").isNull() | (F.trunc("date", unit) != F.col("_b_"))).alias("rebalance"))


def capped(weights: DataFrame, cap: float, by: str = "date", key: str = "symbol") -> DataFrame:
    """weight := min(cap, s * weight) with the s that makes each group sum to 1: what capping and redistributing again and again tends to.

    Of the k largest weights at the cap, k is the least for which the next one, scaled up by what is left, stays under
    it. Raises where cap times the group's size is under 1.
    """
    w = Window.partitionBy(by).orderBy(F.desc("weight"), key)
    ranked = weights.withColumns({"_k_": F.row_number().over(w) - 1, "_before_": F.coalesce(F.sum("weight").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "_n_": F.count("*").over(Window.partitionBy(by))})
    ok = ranked.withColumn("_n_", F.when(F.col("_n_") * cap < 1 - 1e-12, F.raise_error(F.lit("the cap is infeasible: cap times assets is under 1"))).otherwise(F.col("_n_")))
    scale = F.try_divide(1 - F.col("_k_") * cap, 1 - F.col("_before_"))
    fits = F.when((F.col("_n_") > 0) & (scale * F.col("weight") <= cap + 1e-15), scale)
    first = F.min(F.struct(F.when(fits.isNotNull(), F.col("_k_")).otherwise(F.lit(2**31)).alias("k"), fits.alias("s"))).over(Window.partitionBy(by))
    return ok.withColumn("_s_", first["s"]).withColumn("weight", F.least(F.lit(cap), F.coalesce(F.col("_s_"), F.lit(0.0)) * F.col("weight") + F.when(F.col("_s_").isNull(), F.lit(cap)).otherwise(0.0))).drop("_k_", "_before_", "_n_", "_s_")


def target_weights(panel: DataFrame, method: str = "equal") -> DataFrame:
    """Weights by date: equal, or inverse to the volatility known the day before (raises where that isn't positive)."""
    by = Window.partitionBy("date")
    if method == "equal":
        return panel.select("date", "symbol", (1 / F.count("*").over(by)).alias("weight"))
    v = F.lag("volatility").over(Window.partitionBy("symbol").orderBy("date"))
    known = panel.withColumn("_v_", v).where("_v_ IS NOT NULL").withColumn("_v_", F.when(F.col("_v_") > 0, F.col("_v_")).otherwise(F.raise_error(F.lit("volatility must be positive"))))
    return known.select("date", "symbol", (1 / F.col("_v_") / F.sum(1 / F.col("_v_")).over(by)).alias("weight"))


def periods_of(panel: DataFrame, unit: str, base: float, cost_bps: float, weight: Column | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a rebalanced index is chained from: assets' rows with their period's first weight and price ratio, periods with level and turnover at their start, and days with what was asked and done."""
    sound = panel.groupBy("date").agg(F.min("price").alias("_min_"), F.count("*").alias("_n_"))
    before = F.lag(F.trunc("date", unit)).over(Window.orderBy("date"))
    days = sound.withColumn("asked", before.isNull() | (F.trunc("date", unit) != before)).withColumn("go", F.col("asked") & (F.col("_min_") > 0))
    days = days.withColumn("period", F.sum(F.col("go").cast("int")).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))).where("period > 0")
    rows = panel.join(days.select("date", "period", "go", "_n_"), "date").withColumn("_w_", F.coalesce(weight, 1 / F.col("_n_")) if weight is not None else 1 / F.col("_n_"))
    start = Window.partitionBy("symbol", "period").orderBy("date")
    parts = rows.withColumns({"_r_": F.col("price") / F.first("price").over(start), "_w0_": F.first("_w_").over(start)})
    # the first day of a period is also the last valuation of the one before
    own = Window.partitionBy("symbol").orderBy("period")
    ends = rows.where("go").withColumns({"_was_in_": F.lag("period").over(own), "_g_": F.lag("_w_").over(own) * F.col("price") / F.lag("price").over(own)})
    drift = ends.where("_was_in_ = period - 1").select("symbol", F.col("_was_in_").alias("period"), F.col("_w_").alias("_next_"), "_g_")
    whole = Window.partitionBy("period")
    drift = drift.withColumn("_total_", F.sum("_g_").over(whole)).groupBy("period").agg(F.max("_total_").alias("ratio"), (F.sum(F.abs(F.col("_next_") - F.col("_g_") / F.col("_total_"))) / 2).alias("turnover"))
    chain = drift.withColumn("factor", F.col("ratio") * (1 - F.col("turnover") * cost_bps / 1e4)).withColumn("level0", base * F.product("factor").over(Window.orderBy("period").rowsBetween(Window.unboundedPreceding, 0)))
    begin = chain.select((F.col("period") + 1).alias("period"), "level0", "turnover", "ratio", F.lag("level0", 1, base).over(Window.orderBy("period")).alias("_was_"))
    return parts, begin, days


def rebalanced_index(panel: DataFrame, unit: str = "quarter", base: float = 100.0, cost_bps: float = 10.0, weight: Column | None = None) -> DataFrame:
    """An index that returns to its target weights on rebalance dates: date, gross_level, level, turnover, rebalance_executed.

    Units are constant within a period that starts on p, so the level is level_p times the weighted price ratios to p;
    the cost of the next rebalance depends on these ratios alone. Each period gives one factor, and the levels are
    chained with a product over periods. Only per-period and per-date rows reach the windows without keys. A
    rebalance on a date with a price of 0 or less is skipped.
    """
    parts, begin, _ = periods_of(panel, unit, base, cost_bps, weight)
    values = parts.groupBy("date", "period", "go").agg(F.sum(F.col("_w0_") * F.col("_r_")).alias("v"))
    out = values.join(begin, "period", "left")
    level = F.coalesce("level0", F.lit(base)) * F.col("v")
    gross = F.when(F.col("go") & F.col("ratio").isNotNull(), F.col("_was_") * F.col("ratio")).otherwise(level)
    return out.select("date", gross.alias("gross_level"), level.alias("level"), F.when(F.col("go"), F.coalesce("turnover", F.lit(1.0))).otherwise(0.0).alias("turnover"), F.col("go").alias("rebalance_executed"))


def index_history(panel: DataFrame, unit: str = "quarter", base: float = 100.0, cost_bps: float = 10.0, weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """A rebalanced index whole: a row a day, and a row a day and asset with its weights.

    Days: gross_level, level, daily_return, rebalance_requested, executed and skipped (a price of 0 or less), turnover and
    transaction_cost (0 on the first day), running_peak, drawdown. Assets: actual_weight after the day's rebalance, which is
    the first weight of the period times the price ratio since, as a share of all; target_weight where one was executed.
    The panel is stored once for all branches. Days before the first sound one are left out.
    """
    parts, begin, days = periods_of(stored(panel), unit, base, cost_bps, weight)
    parts = stored(parts.select("date", "symbol", "period", "go", (F.col("_w0_") * F.col("_r_")).alias("_v_"), "_w0_"))
    values = parts.groupBy("date", "period", "go").agg(F.sum("_v_").alias("_total_"))
    out = values.join(begin, "period", "left").join(days.select("date", "asked"), "date")
    level = F.coalesce("level0", F.lit(base)) * F.col("_total_")
    later = F.col("go") & F.col("ratio").isNotNull()
    out = out.select("date", F.when(later, F.col("_was_") * F.col("ratio")).otherwise(level).alias("gross_level"), level.alias("level"), F.col("asked").alias("rebalance_requested"), F.col("go").alias("rebalance_executed"), F.when(later, F.col("turnover")).otherwise(0.0).alias("turnover"))
    run = Window.orderBy("date")  # a row a day
    out = out.withColumns({"transaction_cost": F.when(F.col("rebalance_executed"), F.col("gross_level") - F.col("level")).otherwise(0.0), "rebalance_skipped": F.col("rebalance_requested") & ~F.col("rebalance_executed"), "daily_return": F.try_divide(F.col("level"), F.lag("level").over(run)) - 1, "running_peak": F.max("level").over(run.rowsBetween(Window.unboundedPreceding, 0))})
    weights = parts.join(values.select("date", "_total_"), "date").select("date", "symbol", F.try_divide(F.col("_v_"), F.col("_total_")).alias("actual_weight"), F.when(F.col("go"), F.col("_w0_")).alias("target_weight"), F.col("go").alias("rebalance_executed"))
    return out.withColumn("drawdown", F.try_divide(F.col("level"), F.col("running_peak")) - 1), weights


def cash_reserve(portfolio: DataFrame, reserve: float, base: float = 100.0) -> DataFrame:
    """Returns scaled by 1 - reserve and compounded anew: daily_return, level, peak, drawdown of (portfolio, date, daily_return)."""
    run = Window.partitionBy("portfolio").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    out = portfolio.withColumn("daily_return", F.coalesce("daily_return", F.lit(0.0)) * (1 - reserve))
    out = out.withColumn("level", base * F.product(1 + F.col("daily_return")).over(run)).withColumn("peak", F.max("level").over(run))
    return out.withColumn("drawdown", F.try_divide(F.col("level"), F.col("peak")) - 1)


def local_portfolio(panel: DataFrame, base: float = 100.0) -> DataFrame:
    """Mean local-currency return over the dates on which every symbol has a price, compounded, with its drawdown.

    Symbols without any price don't count. The first return is 0; no whole date, no rows.
    """
    priced = panel.where("price IS NOT NULL")
    names = priced.agg(F.count_distinct("symbol").alias("_all_"))
    whole = priced.withColumn("_have_", F.count("*").over(Window.partitionBy("date"))).join(F.broadcast(names), F.col("_have_") == F.col("_all_"))  # one row
    before = F.lag("price").over(Window.partitionBy("symbol").orderBy("date"))
    r = whole.withColumn("r", F.coalesce(F.try_divide(F.col("price"), before) - 1, F.lit(0.0))).groupBy("date").agg(F.avg("r").alias("daily_return"))
    so_far = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # a row a date
    level = r.withColumn("level", base * F.product(1 + F.col("daily_return")).over(so_far))
    return level.withColumn("drawdown", F.col("level") / F.max("level").over(so_far) - 1)
