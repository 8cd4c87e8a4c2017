"""Registered queries over equities, with SQL that gives the same rows: a symbol for each supplier and line number, some with short histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import cleaning, equity, strategies
from barloom.plans.market import BARS, FULL, PANEL, W, bars, query
from barloom.sources import adapters

AT = "l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
EQUITY = f"""WITH bars AS (SELECT l_suppkey || '-' || l_linenumber AS symbol, CAST(l_shipdate AS DATE) AS date, first(p ORDER BY {AT}) AS open, max(p) AS high, min(p) AS low, last(p ORDER BY {AT}) AS close, sum(l_quantity)::DOUBLE AS volume
  FROM (SELECT *, l_extendedprice / l_quantity AS p FROM lineitem) GROUP BY 1, 2)"""


def equities(s, d):
    raw = adapters.bars_lineitem(s, d, F.concat_ws("-", "l_suppkey", "l_linenumber")).withColumn("adjusted_close", F.lit(None).cast("double"))
    return cleaning.clean_equity(raw, F.col("date"))


@query("WIN41_ticker_backtests", FULL.replace(BARS, EQUITY) + """, n AS (SELECT symbol, count(*) AS rows_available FROM bars GROUP BY 1), h AS (SELECT symbol, cumulative_return AS hold FROM fullm WHERE strategy_name = 'buy_and_hold'),
o AS (SELECT *, rows_available < 60 AND strategy_name NOT IN ('buy_and_hold', 'breakout_20d') AS insufficient_history FROM fullm JOIN n USING (symbol) JOIN h USING (symbol) WHERE strategy_name <> 'technical_news_filter')
SELECT symbol, strategy_name, rows_available::BIGINT AS rows_available, insufficient_history, CASE WHEN NOT insufficient_history THEN trade_count::BIGINT END AS trade_count, CASE WHEN NOT insufficient_history THEN cumulative_return > hold END AS beats_holding,
  """ + ", ".join(f"CASE WHEN NOT insufficient_history THEN round({c}, 5) + 0.0 END AS {n}" for c, n in (("log10(greatest(1 + cumulative_return, 1e-9))", "log_return"), ("sharpe_ratio", "sharpe_ratio"), ("max_drawdown", "max_drawdown"), ("exposure", "exposure"), ("win_rate", "win_rate"))) + " FROM o")
def _(s, d):
    rules = {n: c for n, c in strategies.rules().items() if n != "technical_news_filter"}  # no news of these symbols
    m = equity.ticker_backtests(equities(s, d), rules)
    five = lambda c, n: (F.round(c, 5) + F.lit(0.0)).alias(n)
    return m.select("symbol", "strategy_name", "rows_available", "insufficient_history", "trade_count", (F.col("outperformance_vs_buy_hold") > 0).alias("beats_holding"), five(F.log10(F.greatest(1 + F.col("cumulative_return"), F.lit(1e-9))), "log_return"), *(five(F.col(c), c) for c in ("sharpe_ratio", "max_drawdown", "exposure", "win_rate")))


@query("WIN42_market_benchmark", EQUITY + f""", l AS (SELECT symbol, date, 100 * close / first(close) OVER ({W}) AS level FROM bars), r AS (SELECT *, level / lag(level) OVER ({W}) - 1 AS r, level / max(level) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM l),
m AS (SELECT symbol, min(date) AS start_date, max(date) AS end_date, count(*)::BIGINT AS n, arg_max(level, date) / arg_min(level, date) AS q, stddev_samp(r) * sqrt(252) AS vol, avg(r) * sqrt(252) / nullif(stddev_samp(r), 0) AS sharpe, min(dd) AS dd FROM r GROUP BY 1)
SELECT CASE WHEN symbol = '1-1' THEN 'MARKET_' ELSE 'BH_' END || symbol AS series_id, CASE WHEN symbol = '1-1' THEN 'market_index' ELSE 'buy_and_hold' END AS benchmark_type, symbol, start_date, end_date, n,
  CASE WHEN n >= 2 THEN round(q - 1, 6) + 0.0 END AS total_return, CASE WHEN n >= 2 THEN round(pow(q, 365.25 / date_diff('day', start_date, end_date)) - 1, 6) + 0.0 END AS cagr, round(vol, 6) AS volatility, round(sharpe, 6) + 0.0 AS sharpe, CASE WHEN n >= 2 THEN round(dd, 6) + 0.0 END AS max_drawdown FROM m""")
def _(s, d):
    return equity.buy_hold_benchmarks(equities(s, d).select("symbol", "date", F.col("adjusted_close").alias("price")), ("1-1",)).drop("non_positive")


@query("WIN37_portfolio_build", "WITH RECURSIVE " + PANEL.replace(BARS, BARS[:-1] + " QUALIFY dense_rank() OVER (ORDER BY o_orderpriority) <= 4)").removeprefix("WITH ") + f""",
r AS (SELECT *, price / nullif(lag(price) OVER ({W}), 0) - 1 AS r, dense_rank() OVER (ORDER BY date) AS n FROM panel), v AS (SELECT *, CASE WHEN count(r) OVER f >= 20 THEN stddev_samp(r) OVER f END AS v FROM r WINDOW f AS ({W} ROWS 59 PRECEDING)), k AS (SELECT *, lag(v) OVER ({W}) AS k FROM v),
w AS (SELECT date, symbol, price, 1 / k / sum(1 / k) OVER (PARTITION BY date) AS weight FROM k WHERE n > 60),
it AS (SELECT date, symbol, price, weight, 0 AS i FROM w UNION ALL SELECT date, symbol, price, CASE WHEN weight >= 0.28 THEN 0.28 ELSE weight * (1 - 0.28 * count(*) FILTER (weight >= 0.28) OVER (PARTITION BY date)) / sum(weight) FILTER (weight < 0.28) OVER (PARTITION BY date) END, i + 1 FROM it WHERE i < 8),
days AS (SELECT date, row_number() OVER (ORDER BY date) AS t, coalesce(date_trunc('quarter', date) <> lag(date_trunc('quarter', date)) OVER (ORDER BY date), true) AS go FROM (SELECT DISTINCT date FROM w)),
ps AS (SELECT t, go, date, list(price ORDER BY symbol) AS p, list(weight ORDER BY symbol) AS w FROM it JOIN days USING (date) WHERE i = 8 GROUP BY ALL),
rec AS (SELECT t, date, go, list_transform(list_zip(p, w), lambda z: 100 * z[2] / z[1]) AS u, 100.0::DOUBLE AS level FROM ps WHERE t = 1
UNION ALL SELECT t, date, go, CASE WHEN go THEN list_transform(list_zip(p, w), lambda z: net * z[2] / z[1]) ELSE u END, CASE WHEN go THEN net ELSE gross END
FROM (SELECT *, gross * (1 - list_sum(list_transform(list_zip(u, p, w), lambda z: abs(z[3] - z[1] * z[2] / gross))) / 2 * 10 / 1e4) AS net FROM (SELECT ps.t, ps.date, ps.go, ps.p, ps.w, rec.u, list_sum(list_transform(list_zip(rec.u, ps.p), lambda z: z[1] * z[2])) AS gross FROM rec JOIN ps ON ps.t = rec.t + 1))),
c AS (SELECT date, go, coalesce(level / lag(level) OVER (ORDER BY date) - 1, 0) * 0.9::DOUBLE AS daily_return FROM rec), l AS (SELECT *, 100 * product(1 + daily_return) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS level FROM c)
SELECT date, go AS rebalance_executed, round(daily_return, 6) + 0.0 AS daily_return, round(level, 5) AS level, round(level / max(level) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 6) + 0.0 AS drawdown FROM l""")
def _(s, d):
    prices = bars(s, d).select("date", "symbol", (F.col("close") / 7).alias("price"))
    p = equity.build_portfolio(prices, max_positions=4, cap=0.28, method="inverse_volatility", reserve=0.1)
    return p.select("date", "rebalance_executed", "daily_return", F.round("level", 5).alias("level"), "drawdown")
