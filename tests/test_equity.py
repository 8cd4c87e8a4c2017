"""Rules on adjusted prices, buy-and-hold benchmarks and the portfolio."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import equity, strategies

DAY = dt.date(2024, 1, 1)


def prices(spark, values):
    rows = [(s, DAY + dt.timedelta(i), float(v)) for s, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "symbol string, date date, price double")


def test_short_histories_have_no_metrics(spark):
    p = prices(spark, {"A": [100 + i for i in range(80)], "B": [100 + i for i in range(20)]}).withColumn("adjusted_close", F.col("price") / 2)
    bars = p.withColumns({c: F.col("price") for c in ("open", "high", "low", "close")}).withColumn("volume", F.lit(1.0))
    rules = {"buy_and_hold": strategies.buy_and_hold(), "moving_average_cross": strategies.moving_average_cross(), "breakout_20d": F.col("breakout")}
    got = {(r.symbol, r.strategy_name): r for r in equity.ticker_backtests(bars, rules).collect()}
    assert len(got) == 6 and got["B", "moving_average_cross"].insufficient_history
    assert got["B", "moving_average_cross"].cumulative_return is None and got["B", "moving_average_cross"].rows_available == 20
    assert not got["B", "breakout_20d"].insufficient_history and not got["A", "moving_average_cross"].insufficient_history
    hold = got["A", "buy_and_hold"]
    assert hold.outperformance_vs_buy_hold == 0 and hold.cumulative_return == pytest.approx(1.79 * (1 + 1 / 100 - 0.0015) / (1 + 1 / 100) - 1, abs=1e-9)


def test_buy_and_hold_needs_a_positive_first_price(spark):
    m = {r.symbol: r for r in equity.buy_hold_benchmarks(prices(spark, {"A": [10, 20], "B": [0, 5], "M": [4, 5, 3]}), ("M",)).collect()}
    assert set(m) == {"A", "M"} and (m["A"].series_id, m["M"].series_id, m["M"].benchmark_type) == ("BH_A", "MARKET_M", "market_index")
    assert m["A"].total_return == pytest.approx(1.0) and m["M"].max_drawdown == pytest.approx(-0.4)


def test_portfolio(spark):
    p = prices(spark, {"A": [10, 11, 11], "B": [10, 10, 10], "C": [1, 9, 1]})
    day = equity.build_portfolio(p, max_positions=2, cap=0.3, reserve=0.5).orderBy("date").collect()  # the cap can't be met by two, so it is left off
    assert [r.level for r in day] == pytest.approx([100.0, 102.5, 102.5]) and [r.rebalance_executed for r in day] == [True, False, False]
    with pytest.raises(ValueError, match="two symbols"):
        equity.build_portfolio(p.where("symbol = 'A'"))


def test_portfolio_by_inverse_volatility(spark):
    a, b = [100 + 10 * (i % 2) for i in range(40)], [100 + 5 * (i % 2) for i in range(40)]
    day = equity.build_portfolio(prices(spark, {"A": a, "B": b}), method="inverse_volatility", unit="year", lookback=10, least=5).orderBy("date").collect()
    moves = lambda x: [x[i] / x[i - 1] - 1 for i in range(1, 10)]
    spread = lambda r: (sum((v - sum(r) / len(r)) ** 2 for v in r) / (len(r) - 1)) ** 0.5
    inverse = [1 / spread(moves(x)) for x in (a, b)]
    share = inverse[0] / sum(inverse)
    assert len(day) == 30 and day[0].date == DAY + dt.timedelta(10)
    assert day[1].level == pytest.approx(100 * (share * a[11] / a[10] + (1 - share) * b[11] / b[10]))


def test_rules_of_a_ticker_share_its_rows(spark):
    """Bars of many symbols are dealt out once, and rows are multiplied by the rules only as metrics."""
    from barloom.operators import equity, strategies
    from barloom.plans.equity import equities

    rules = {n: c for n, c in strategies.rules().items() if n != "technical_news_filter"}
    plan = equity.ticker_backtests(equities(spark, "/root/testdata/sf0.001"), rules)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.index("Generate ") < plan.index("HashAggregate(") < plan.index("lag(")
