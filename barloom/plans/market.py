"""Registered queries over bars: indicators, rules, marts, indices; each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions.nullsafe import divide
from barloom.operators import cleaning, index, indicators, ledger, metrics, news, staging, strategies
from barloom.operators.windows import asof, fill_forward, interpolate, latest_per_key, series
from barloom.plans import story
from barloom.plans.story import STORY
from barloom.sources import adapters, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PERIODS = (("calibration", "1995-01-01", "1998-12-31"), ("validation", "1999-01-01", "1999-12-31"), ("test", "2000-01-01", "2001-12-31"))


def rounded(df: DataFrame, exact: tuple[str, ...] = ()) -> DataFrame:
    """Doubles to six places (no negative zero), counts as long: what two engines agree on. Exact columns are equal to the bit as they are."""
    kinds = {"double": lambda c: F.round(c, 6) + F.lit(0.0), "int": lambda c: c.cast("long"), "float": lambda c: F.round(c.cast("double"), 6)}
    return df.select(*(kinds[t](F.col(c)).alias(c) if t in kinds and c not in exact else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None, exact: tuple[str, ...] = ()) -> Callable:
    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), exact)
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return put


def out(keys: str, doubles: str, longs: str = "") -> str:
    """A select list: keys as they are, doubles to six places, counts as BIGINT."""
    return ", ".join([*keys.split(), *(f"round({c}, 6) + 0.0 AS {c}" for c in doubles.split()), *(f"{c}::BIGINT AS {c}" for c in longs.split())])


# ---- SQL of the shared tables

BARS = """WITH bars AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, first(p ORDER BY o_orderdate, o_orderkey, o_totalprice) AS open, max(p) AS high, min(p) AS low,
  last(p ORDER BY o_orderdate, o_orderkey, o_totalprice) AS close, count(*)::DOUBLE AS volume FROM (SELECT *, o_totalprice / 1000 AS p FROM orders) GROUP BY 1, 2)"""
W = "PARTITION BY symbol ORDER BY date"


def mean(c: str, n: int, part: str = W) -> str:
    f = f"OVER ({part} ROWS {n - 1} PRECEDING)"
    return f"CAST(sum(CAST({c} AS DECIMAL(24,6))) {f} AS DOUBLE) / nullif(count({c}) {f}, 0)"


RET = BARS + f""", ret AS (SELECT *, close / nullif(previous_close, 0) - 1 AS simple_return, ln(close / nullif(previous_close, 0)) AS log_return FROM (SELECT *, lag(close) OVER ({W}) AS previous_close FROM bars))"""
TECH = RET + f""", t1 AS (SELECT *, {", ".join(f"{mean('close', n)} AS sma_{n}" for n in (20, 50, 100, 200))}, stddev_samp(close) OVER ({W} ROWS 19 PRECEDING) AS std_20,
  stddev_samp(simple_return) OVER ({W} ROWS 19 PRECEDING) AS volatility_20d, volume / nullif({mean("volume", 20)}, 0) AS volume_ratio_20d,
  CASE WHEN previous_close IS NULL THEN NULL ELSE greatest(high - low, abs(high - previous_close), abs(low - previous_close)) END AS true_range,
  CASE WHEN previous_close IS NULL THEN NULL ELSE greatest(close - previous_close, 0) END AS up, CASE WHEN previous_close IS NULL THEN NULL ELSE greatest(previous_close - close, 0) END AS down,
  max(close) OVER ({W} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS previous_high, min(close) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS previous_low FROM ret),
t2 AS (SELECT *, {mean("true_range", 14)} AS atr_14, {mean("up", 14)} AS au, {mean("down", 14)} AS ad FROM t1),
t3 AS (SELECT *, CASE WHEN au IS NULL OR ad IS NULL THEN NULL WHEN ad = 0 AND au = 0 THEN 50.0 WHEN ad = 0 THEN 100.0 ELSE 100 - 100 / (1 + au / ad) END AS rsi_14 FROM t2),
t4 AS (SELECT *, CASE WHEN rsi_14 IS NULL THEN NULL WHEN hi - lo = 0 THEN 50.0 ELSE 100 * ((rsi_14 - lo) / (hi - lo)) END AS stochastic_rsi_k FROM (SELECT *, min(rsi_14) OVER ({W} ROWS 13 PRECEDING) AS lo, max(rsi_14) OVER ({W} ROWS 13 PRECEDING) AS hi FROM t3)),
tech AS (SELECT *, {mean("stochastic_rsi_k", 3)} AS stochastic_rsi_d FROM t4)"""
SIGNALS = TECH + ", " + STORY + f""", tn AS (SELECT t.*, {", ".join(f"coalesce(f.{c}, 0) AS {c}" for c in ("news_volume", "weighted_sentiment_score", "geopolitical_risk_score", "supply_shock_score"))} FROM tech t LEFT JOIN feat f ON f.topic_id = t.symbol AND f.date = t.date),
latch AS (SELECT *, max(CASE WHEN close > previous_high THEN date END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS d_in, max(CASE WHEN close < previous_low THEN date END) OVER ({W} ROWS UNBOUNDED PRECEDING) AS d_out FROM tn),
sig AS (SELECT symbol, date, close, simple_return, s.strategy_name, CASE s.strategy_name WHEN 'buy_and_hold' THEN 1 WHEN 'moving_average_cross' THEN (sma_20 >= sma_50)::INT
  WHEN 'moving_average_stoch_rsi' THEN coalesce((sma_20 >= sma_50 AND stochastic_rsi_k >= 20 AND stochastic_rsi_d <= 80)::INT, 0)
  WHEN 'technical_news_filter' THEN coalesce((close > sma_20 AND sma_20 >= sma_50 AND coalesce(rsi_14, 50) BETWEEN 30 AND 75 AND weighted_sentiment_score >= -0.15 AND geopolitical_risk_score < 0.75 AND supply_shock_score < 0.75)::INT, 0)
  ELSE (d_in IS NOT NULL AND (d_out IS NULL OR d_in > d_out))::INT END AS signal
  FROM latch, (VALUES ('buy_and_hold'), ('moving_average_cross'), ('moving_average_stoch_rsi'), ('technical_news_filter'), ('breakout_20d')) AS s(strategy_name))"""
WS = "PARTITION BY strategy_name, symbol ORDER BY date"
DAILY = SIGNALS + f""", d1 AS (SELECT *, lag(signal, 1, 0) OVER ({WS}) AS executed_position FROM sig),
d2 AS (SELECT *, executed_position * coalesce(simple_return, 0) AS strategy_return, lag(executed_position, 1, 0) OVER ({WS}) AS previous_position FROM d1),
d3 AS (SELECT *, abs(executed_position - previous_position) AS position_change FROM d2),
d4 AS (SELECT *, position_change * 0.001::DOUBLE AS fee_cost, position_change * 0.0005::DOUBLE AS slippage_cost FROM d3),
d5 AS (SELECT *, strategy_return - fee_cost - slippage_cost AS net_return FROM d4),
daily AS (SELECT *, exp(sum(ln(greatest(1 + net_return, 1e-6))) OVER ({WS} ROWS UNBOUNDED PRECEDING)) - 1 AS cumulative_return,
  coalesce(exp(sum(CASE WHEN simple_return IS NULL THEN NULL ELSE ln(greatest(1 + simple_return, 1e-6)) END) OVER ({WS} ROWS UNBOUNDED PRECEDING)) - 1, 0) AS cumulative_asset_return,
  sum(fee_cost + slippage_cost) OVER ({WS} ROWS UNBOUNDED PRECEDING) AS cumulative_cost FROM d5)"""
PERIOD = "CASE " + " ".join(f"WHEN date BETWEEN DATE '{a}' AND DATE '{z}' THEN '{n}'" for n, a, z in reversed(PERIODS)) + " ELSE 'out_of_scope' END"


def metric_sql(source: str, keys: str) -> str:
    k = ", ".join(keys.split())
    return f"""dd AS (SELECT *, (1 + cumulative_return) / max(1 + cumulative_return) OVER (PARTITION BY {k} ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM {source}),
m0 AS (SELECT {k}, min(date) AS first_date, max(date) AS last_date, count(*) AS days, arg_max(cumulative_return, date) AS cumulative_return, arg_max(cumulative_asset_return, date) AS buy_hold_cumulative_return,
  stddev_samp(net_return) * sqrt(252) AS annualized_volatility, avg(net_return) * 252 / nullif(stddev_samp(net_return) * sqrt(252), 0) AS sharpe_ratio, avg(net_return) * 252 / nullif(stddev_samp(net_return) FILTER (net_return < 0) * sqrt(252), 0) AS sortino_ratio,
  min(drawdown) AS max_drawdown, count(*) FILTER (net_return > 0) / nullif(count(*) FILTER (net_return <> 0), 0) AS win_rate, coalesce(sum(net_return) FILTER (net_return > 0), 0) / nullif(-sum(net_return) FILTER (net_return < 0), 0) AS profit_factor, avg(abs(executed_position)) AS exposure
  FROM dd GROUP BY {k}),
m1 AS (SELECT *, pow(greatest(1 + cumulative_return, 1e-6), 252.0 / days) - 1 AS annualized_return FROM m0),
met AS (SELECT *, annualized_return / nullif(abs(max_drawdown), 0) AS calmar_ratio FROM m1)"""


METRIC_DOUBLES = "cumulative_return buy_hold_cumulative_return annualized_volatility sharpe_ratio sortino_ratio max_drawdown win_rate profit_factor exposure annualized_return calmar_ratio"
FULL = DAILY + ", " + metric_sql("daily", "strategy_name symbol") + """,
costs AS (SELECT strategy_name, symbol, count(*) AS trade_count, sum(fee_cost) AS total_fees, sum(slippage_cost) AS total_slippage FROM daily WHERE position_change > 0 GROUP BY 1, 2),
runs AS (SELECT strategy_name, symbol, run, min(date) AS first_date, max(date) AS last_date, count(*) AS days FROM (SELECT *, sum((executed_position = 0)::INT) OVER (PARTITION BY strategy_name, symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS run FROM daily) WHERE executed_position <> 0 GROUP BY 1, 2, 3),
lens AS (SELECT strategy_name, symbol, avg(days) AS average_position_days FROM runs GROUP BY 1, 2),
fullm AS (SELECT met.*, coalesce(trade_count, 0) AS trade_count, coalesce(total_fees, 0) AS total_fees, coalesce(total_slippage, 0) AS total_slippage, average_position_days, cumulative_return - buy_hold_cumulative_return AS outperformance
  FROM met LEFT JOIN costs USING (strategy_name, symbol) LEFT JOIN lens USING (strategy_name, symbol))"""

# ---- the chain as DataFrames


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.bars_orders(spark, sf_dir)


def tech(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.technical(bars(spark, sf_dir))


def signals(spark: SparkSession, sf_dir: str, also: Sequence[str] = ()) -> DataFrame:
    """The rules on indicators and news, with further columns of them. News is joined to the bars, which are dealt by symbol and date already, before the one shuffle by symbol."""
    with_news = news.with_news(bars(spark, sf_dir), story.features(spark, sf_dir))
    return strategies.fan_out(strategies.breakout_state(indicators.technical(with_news)), strategies.rules(), ("symbol", "date", "close", "simple_return", *also))


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strategies.compounded(strategies.with_costs(strategies.daily_returns(signals(spark, sf_dir))))


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.full_metrics(daily(spark, sf_dir))


def by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = strategies.with_costs(strategies.daily_returns(signals(spark, sf_dir))).withColumn("period", metrics.assign_period(F.col("date"), PERIODS)).where("period <> 'out_of_scope'")
    return strategies.compounded(d, ("symbol", "strategy_name", "period"))


PERIOD_DAILY = DAILY + f""", pd AS (SELECT *, {PERIOD} AS period FROM d5), pdaily AS (SELECT *, exp(sum(ln(greatest(1 + net_return, 1e-6))) OVER w) - 1 AS cumulative_return,
  coalesce(exp(sum(CASE WHEN simple_return IS NULL THEN NULL ELSE ln(greatest(1 + simple_return, 1e-6)) END) OVER w) - 1, 0) AS cumulative_asset_return, sum(fee_cost + slippage_cost) OVER w AS cumulative_cost
  FROM pd WHERE period <> 'out_of_scope' WINDOW w AS (PARTITION BY strategy_name, symbol, period ORDER BY date ROWS UNBOUNDED PRECEDING))"""
PERIOD_METRICS = PERIOD_DAILY + ", " + metric_sql("pdaily", "strategy_name symbol period") + """,
pcosts AS (SELECT strategy_name, symbol, period, count(*) AS trade_count FROM pdaily WHERE position_change > 0 GROUP BY 1, 2, 3), pm AS (SELECT met.*, coalesce(trade_count, 0) AS trade_count FROM met LEFT JOIN pcosts USING (strategy_name, symbol, period))"""
PM = "strategy_name symbol period"


def period_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.strategy_metrics(by_period(spark, sf_dir), PM.split(), also=(F.count_if(F.expr(metrics.TRADED)).alias("trade_count"),))


# ---- scans and staging


@query("SRC1_scan_raw_table", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_totalprice > 300000")
def _(s, d):
    return tables.scan(s, f"{d}/orders.parquet", ["o_orderkey", "o_orderpriority"], "o_totalprice > 300000")


@query("SRC9_incremental_window", "SELECT max(CAST(o_orderdate AS DATE)) + 1 AS from_date, DATE '2002-01-01' AS to_date FROM orders")
def _(s, d):
    return tables.next_window(bars(s, d), "2002-01-01", "1990-01-01")


@query("SRC10_mart_scan", SIGNALS + " SELECT strategy_name, symbol, date, signal::BIGINT AS signal FROM sig WHERE strategy_name = 'breakout_20d' AND symbol = '1-URGENT' AND date BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'")
def _(s, d):
    return staging.matching(staging.between(signals(s, d), "1996-01-01", "1996-12-31"), strategy_name="breakout_20d", symbol="1-URGENT").select("strategy_name", "symbol", "date", "signal")


@query("PRJ1_stg_prices", "SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, round(max_by(o_totalprice, o_orderkey), 6) AS price FROM orders GROUP BY 1, 2")
def _(s, d):
    raw = adapters.read(s, d, "orders").select(F.col("o_orderpriority").alias("symbol"), F.col("o_orderdate").alias("date"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("ingested_at"))
    return cleaning.staged(raw, {"symbol": "string", "date": "date", "price": "double", "ingested_at": "bigint"}, ["symbol", "date"]).drop("ingested_at")


@query("WIN23_latest_per_key", BARS + f" SELECT {out('symbol date', 'close')} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC) = 1")
def _(s, d):
    return latest_per_key(bars(s, d), ["symbol"], [F.desc("date")]).select("symbol", "date", "close")


@query("CLN3_quality_report", BARS + " SELECT symbol, count(*)::BIGINT AS rows, (count(*) - count(DISTINCT date))::BIGINT AS duplicates, 0::BIGINT AS missing_close, 0::BIGINT AS non_positive, count(*) FILTER (high < greatest(open, low, close) OR low > least(open, high, close))::BIGINT AS inconsistent, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY 1")
def _(s, d):
    return cleaning.quality_report(bars(s, d))


GAPPY = BARS + ", cal AS (SELECT DISTINCT date FROM bars), gap AS (SELECT s.symbol, cal.date, b.close / 7 AS price FROM cal, (SELECT DISTINCT symbol FROM bars) s LEFT JOIN bars b ON b.symbol = s.symbol AND b.date = cal.date)"


def gappy(s, d):
    b = bars(s, d)
    symbols = F.broadcast(b.select("symbol").distinct())  # the universe: a row a symbol
    return b.select("date").distinct().crossJoin(symbols).join(b.select("symbol", "date", (F.col("close") / 7).alias("price")), ["symbol", "date"], "left")


@query("CLN5_missing_by_year", GAPPY + " SELECT symbol, year(date)::BIGINT AS year, count(*) FILTER (price IS NULL)::BIGINT AS missing FROM gap GROUP BY 1, 2")
def _(s, d):
    return cleaning.missing_by_year(gappy(s, d), "price")


CARRY = GAPPY + """, num AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS pos FROM gap),
car AS (SELECT *, last(CASE WHEN price IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pos0, last(price IGNORE NULLS) OVER b AS p0, first(CASE WHEN price IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS pos1, first(price IGNORE NULLS) OVER a AS p1 FROM num
  WINDOW b AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query("CLN6_interpolate_limited", CARRY + " SELECT symbol, date, round(CASE WHEN price IS NOT NULL THEN price WHEN pos - pos0 <= 2 THEN p0 + (p1 - p0) * (pos - pos0) / (pos1 - pos0) END, 6) AS price FROM car")
def _(s, d):
    return interpolate(gappy(s, d), "price", ["symbol"], 2)


@query("WIN27_ffill_limited", CARRY + " SELECT symbol, date, round(CASE WHEN pos - pos0 <= 1 THEN p0 END, 6) AS price, price IS NULL AND pos0 IS NOT NULL AND pos - pos0 <= 1 AS price_filled FROM car")
def _(s, d):
    return fill_forward(gappy(s, d), "price", ["symbol"], 1)


@query("JN14_fx_asof", BARS + """, rate AS (SELECT CAST(l_shipdate AS DATE) AS date, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][l_suppkey % 5 + 1] AS symbol, avg(l_discount) + 1 AS rate FROM lineitem GROUP BY 1, 2),
cal AS (SELECT symbol, date, max(rate) AS rate, max(mine) AS mine FROM (SELECT symbol, date, NULL AS rate, 1 AS mine FROM bars UNION ALL SELECT symbol, date, rate, 0 FROM rate) GROUP BY ALL),
num AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS pos FROM cal), car AS (SELECT *, last(CASE WHEN rate IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pos0, last(rate IGNORE NULLS) OVER b AS r0 FROM num WINDOW b AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING))
SELECT symbol, date, round(close, 6) AS close, round(CASE WHEN pos - pos0 <= 5 THEN r0 END, 6) AS rate, round(close / 7.3::DOUBLE * CASE WHEN pos - pos0 <= 5 THEN r0 END, 4) AS converted FROM bars JOIN car USING (symbol, date) WHERE mine = 1""")
def _(s, d):
    names = F.array(*(F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    rate = adapters.read(s, d, "lineitem").groupBy(F.to_date("l_shipdate").alias("date"), F.element_at(names, (F.col("l_suppkey") % 5 + 1).cast("int")).alias("symbol")).agg((F.avg("l_discount") + 1).alias("rate"))
    return asof(bars(s, d).select("symbol", "date", "close"), rate, ["symbol"], "rate", 5).select("symbol", "date", "close", "rate", F.round(F.col("close") / 7.3 * F.col("rate"), 4).alias("converted"))


@query("FLT1_date_range_filter", BARS + f" SELECT {out('symbol date', 'close')} FROM bars WHERE date BETWEEN DATE '1996-03-01' AND DATE '1996-06-30'")
def _(s, d):
    return staging.between(bars(s, d), "1996-03-01", "1996-06-30").select("symbol", "date", "close")


@query("FLT2_attribute_filter", SIGNALS + " SELECT strategy_name, symbol, count(*)::BIGINT AS n FROM sig WHERE symbol IN ('1-URGENT', '2-HIGH') AND strategy_name = 'moving_average_cross' GROUP BY 1, 2")
def _(s, d):
    return staging.matching(signals(s, d), symbol=["1-URGENT", "2-HIGH"], strategy_name="moving_average_cross", no_such_column=1).groupBy("strategy_name", "symbol").agg(F.count("*").alias("n"))


# ---- indicators


@query("WIN1_returns", RET + f" SELECT {out('symbol date', 'simple_return log_return')} FROM ret")
def _(s, d):
    return indicators.returns(bars(s, d)).select("symbol", "date", "simple_return", "log_return")


@query("WIN2_sma", TECH + " SELECT symbol, date, sma_20, sma_50, sma_100, sma_200 FROM tech", ("sma_20", "sma_50", "sma_100", "sma_200"))
def _(s, d):
    return indicators.moving_averages(bars(s, d)).select("symbol", "date", "sma_20", "sma_50", "sma_100", "sma_200")


@query("WIN2_sma_full_frames", TECH + f", c AS (SELECT *, row_number() OVER ({W}) AS n FROM tech) SELECT symbol, date, CASE WHEN n >= 20 THEN sma_20 END AS sma_20, CASE WHEN n >= 50 THEN sma_50 END AS sma_50 FROM c", ("sma_20", "sma_50"))
def _(s, d):
    return indicators.moving_averages(bars(s, d), (20, 50), warm=False).select("symbol", "date", "sma_20", "sma_50")


@query("WIN3_bollinger", TECH + " SELECT symbol, date, round(sma_20 + 2 * std_20, 6) AS bollinger_upper_20d, round(sma_20 - 2 * std_20, 6) AS bollinger_lower_20d FROM tech")
def _(s, d):
    return indicators.bollinger(bars(s, d)).select("symbol", "date", "bollinger_upper_20d", "bollinger_lower_20d")


@query("WIN4_volatility", TECH + " SELECT symbol, date, round(volatility_20d, 6) AS volatility_20d, round(volatility_20d * sqrt(252), 6) AS historical_volatility_20d FROM tech")
def _(s, d):
    return indicators.volatility(indicators.returns(bars(s, d))).select("symbol", "date", "volatility_20d", "historical_volatility_20d")


@query("WIN5_volume_ratio", TECH + f" SELECT {out('symbol date', 'volume_ratio_20d')} FROM tech")
def _(s, d):
    return indicators.volume_ratio(bars(s, d)).select("symbol", "date", "volume_ratio_20d")


@query("WIN6_atr", TECH + f" SELECT {out('symbol date', 'true_range')}, atr_14 FROM tech", ("atr_14",))
def _(s, d):
    return indicators.atr(bars(s, d)).select("symbol", "date", "true_range", "atr_14")


@query("WIN7_rsi", TECH + f" SELECT {out('symbol date', 'rsi_14')} FROM tech")
def _(s, d):
    return indicators.rsi(bars(s, d)).select("symbol", "date", "rsi_14")


@query("WIN8_stoch_rsi", TECH + f" SELECT {out('symbol date', 'stochastic_rsi_k stochastic_rsi_d')} FROM tech")
def _(s, d):
    return tech(s, d).select("symbol", "date", "stochastic_rsi_k", "stochastic_rsi_d")


def kernel_sql(table: str, value: str, span: int, rows: int) -> str:
    a = f"(1 - 2.0::DOUBLE / {span + 1})"
    return f"SELECT x.symbol, x.date, x.n, sum(y.{value} * pow({a}, x.n - y.n)) / sum(pow({a}, x.n - y.n)) AS v FROM {table} x JOIN {table} y ON y.symbol = x.symbol AND y.n BETWEEN x.n - {rows - 1} AND x.n GROUP BY ALL"


@query("WIN9_macd_kernel", BARS + f""", num AS (SELECT symbol, date, close, row_number() OVER ({W}) AS n FROM bars), f AS ({kernel_sql("num", "close", 12, 121)}), s AS ({kernel_sql("num", "close", 26, 121)}),
m AS (SELECT f.symbol, f.date, f.n, f.v AS ema_12, s.v AS ema_26, f.v - s.v AS macd FROM f JOIN s USING (symbol, date, n)), g AS ({kernel_sql("m", "macd", 9, 46)})
SELECT m.symbol, m.date, round(ema_12, 6) AS ema_12, round(ema_26, 6) AS ema_26, round(macd, 6) AS macd, round(g.v, 6) AS macd_signal, round(macd - g.v, 6) AS macd_histogram FROM m JOIN g USING (symbol, date, n)""")
def _(s, d):
    return indicators.macd_kernel(bars(s, d))


def recursive_sql(table: str, value: str, span: int) -> str:
    """The recursion written out: the first value decays, each later one enters with its share."""
    a = f"(2.0::DOUBLE / {span + 1})"
    return f"SELECT x.symbol, x.date, x.n, sum(y.{value} * pow(1 - {a}, x.n - y.n) * CASE WHEN y.n = 1 THEN 1 ELSE {a} END) AS v FROM {table} x JOIN {table} y ON y.symbol = x.symbol AND y.n <= x.n GROUP BY ALL"


@query("WIN10_ema_recursive", BARS + f""", num AS (SELECT symbol, date, close, row_number() OVER ({W}) AS n FROM bars), f AS ({recursive_sql("num", "close", 12)}), s AS ({recursive_sql("num", "close", 26)}),
m AS (SELECT f.symbol, f.date, f.n, f.v AS ema_12, s.v AS ema_26, f.v - s.v AS macd FROM f JOIN s USING (symbol, date, n)), late AS (SELECT symbol, date, n - 25 AS n, macd FROM m WHERE n >= 26), g AS ({recursive_sql("late", "macd", 9)})
SELECT m.symbol, m.date, round(CASE WHEN m.n >= 12 THEN ema_12 END, 6) AS ema_12, round(CASE WHEN m.n >= 26 THEN ema_26 END, 6) AS ema_26, round(CASE WHEN m.n >= 26 THEN macd END, 6) + 0.0 AS macd, round(CASE WHEN g.n >= 9 THEN g.v END, 6) + 0.0 AS macd_signal, round(CASE WHEN g.n >= 9 THEN macd - g.v END, 6) + 0.0 AS macd_histogram
FROM m LEFT JOIN g ON g.symbol = m.symbol AND g.date = m.date""")
def _(s, d):
    return indicators.macd_recursive(bars(s, d))


@query("WIN11_previous_extremes", TECH + f" SELECT {out('symbol date', 'previous_high previous_low')} FROM tech")
def _(s, d):
    return indicators.previous_extremes(bars(s, d)).select("symbol", "date", "previous_high", "previous_low")


@query("WIN12_breakout_state", SIGNALS + f""", b AS (SELECT l.symbol, l.date, s.signal AS breakout, lag(s.signal, 1, 0) OVER (PARTITION BY l.symbol ORDER BY l.date) AS was, l.close, previous_high, previous_low FROM sig s JOIN latch l USING (symbol, date) WHERE strategy_name = 'breakout_20d')
SELECT symbol, date, breakout::BIGINT AS breakout, CASE WHEN was = 1 AND close < previous_low THEN 'exit_breaks_previous_low' WHEN close > previous_high THEN 'entry_breaks_previous_high' WHEN breakout = 1 THEN 'hold_after_breakout' ELSE 'flat_no_breakout' END AS breakout_reason FROM b""")
def _(s, d):
    return strategies.breakout_state(indicators.previous_extremes(bars(s, d))).select("symbol", "date", "breakout", "breakout_reason")


# ---- rules and marts


@query("SET2_strategy_fanout", SIGNALS + " SELECT strategy_name, symbol, date, signal::BIGINT AS signal FROM sig")
def _(s, d):
    return signals(s, d).select("strategy_name", "symbol", "date", "signal")


@query("RUL6_signal_normalise", SIGNALS + " SELECT strategy_name, symbol, date, greatest(least(greatest(signal * 3 - 1, -1), 1), 0)::BIGINT AS signal FROM sig")
def _(s, d):
    return signals(s, d).select("strategy_name", "symbol", "date", strategies.normalise(F.col("signal") * 3 - 1).alias("signal"))


@query("WIN14_executed_position", DAILY + f" SELECT {out('strategy_name symbol date', 'strategy_return', 'executed_position')} FROM daily")
def _(s, d):
    return strategies.daily_returns(signals(s, d)).select("strategy_name", "symbol", "date", "strategy_return", "executed_position")


@query("WIN15_position_cost", DAILY + f" SELECT {out('strategy_name symbol date', 'fee_cost slippage_cost net_return', 'previous_position position_change')} FROM daily")
def _(s, d):
    return strategies.with_costs(strategies.daily_returns(signals(s, d))).select("strategy_name", "symbol", "date", "fee_cost", "slippage_cost", "net_return", "previous_position", "position_change")


@query("WIN16_cumulative_return", DAILY + f" SELECT {out('strategy_name symbol date', 'cumulative_return cumulative_asset_return cumulative_cost')} FROM daily")
def _(s, d):
    return daily(s, d).select("strategy_name", "symbol", "date", "cumulative_return", "cumulative_asset_return", "cumulative_cost")


@query("WIN17_drawdown", DAILY + f", dd AS (SELECT *, (1 + cumulative_return) / max(1 + cumulative_return) OVER ({WS} ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM daily) SELECT {out('strategy_name symbol date', 'drawdown')} FROM dd")
def _(s, d):
    return strategies.drawdowns(daily(s, d), 1 + F.col("cumulative_return")).select("strategy_name", "symbol", "date", "drawdown")


@query("WIN18_position_runs", FULL + f" SELECT {out('strategy_name symbol first_date last_date', '', 'days run')} FROM runs")
def _(s, d):
    return strategies.position_runs(daily(s, d))


@query("RUL7_trades_mart", DAILY + f" SELECT {out('strategy_name symbol date', 'fee_cost slippage_cost', 'previous_position executed_position')}, CASE WHEN previous_position = 0 AND executed_position <> 0 THEN 'open' WHEN previous_position <> 0 AND executed_position = 0 THEN 'close' ELSE 'rebalance' END AS trade_type FROM daily WHERE position_change > 0")
def _(s, d):
    return strategies.trades(daily(s, d))


@query("AGG2_strategy_metrics", FULL + f" SELECT {out('strategy_name symbol first_date last_date', METRIC_DOUBLES, 'days')} FROM met")
def _(s, d):
    return metrics.strategy_metrics(daily(s, d))


@query("AGG3_strategy_metrics_full", FULL + f" SELECT {out('strategy_name symbol', 'cumulative_return total_fees total_slippage average_position_days outperformance', 'trade_count')} FROM fullm")
def _(s, d):
    return full(s, d).select("strategy_name", "symbol", "cumulative_return", "total_fees", "total_slippage", "average_position_days", "outperformance", "trade_count")


@query("AGG4_trade_costs", FULL + f" SELECT {out('strategy_name symbol', 'total_fees total_slippage', 'trade_count')} FROM costs")
def _(s, d):
    return metrics.trade_costs(daily(s, d))


GLOBAL = RET + """, g AS (SELECT date, avg(simple_return) AS daily_return FROM ret WHERE symbol <> '5-LOW' AND simple_return IS NOT NULL GROUP BY date)"""


@query("AGG5_global_benchmark_daily", GLOBAL + f" SELECT {out('date', 'daily_return')} FROM g")
def _(s, d):
    return metrics.benchmark_daily(indicators.returns(bars(s, d)).withColumnRenamed("simple_return", "daily_return"), (F.col("symbol") != "5-LOW") & F.col("daily_return").isNotNull())


@query("WIN19_benchmark_curve", GLOBAL + " SELECT date, round(daily_return, 6) AS daily_return, round(exp(sum(ln(greatest(1 + daily_return, 1e-6))) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) / exp(sum(ln(greatest(1 + daily_return, 1e-6))) OVER ()), 6) AS share_of_end FROM g")
def _(s, d):
    by_date = metrics.benchmark_daily(indicators.returns(bars(s, d)).withColumnRenamed("simple_return", "daily_return"), (F.col("symbol") != "5-LOW") & F.col("daily_return").isNotNull())
    curve = metrics.benchmark_curve(by_date)
    end = curve.agg(F.max_by("benchmark_return", "date").alias("end"))
    return curve.crossJoin(F.broadcast(end)).select("date", "daily_return", divide(1 + F.col("benchmark_return"), 1 + F.col("end")).alias("share_of_end"))  # one row


@query("RUL8_assign_period", BARS + f" SELECT {PERIOD} AS period, count(*)::BIGINT AS n FROM bars GROUP BY 1")
def _(s, d):
    return bars(s, d).groupBy(metrics.assign_period(F.col("date"), PERIODS).alias("period")).agg(F.count("*").alias("n"))


@query("WIN20_period_curves", PERIOD_DAILY + f" SELECT {out('strategy_name symbol period date', 'cumulative_return')} FROM pdaily")
def _(s, d):
    return by_period(s, d).select("strategy_name", "symbol", "period", "date", "cumulative_return")


@query("AGG6_period_metrics", PERIOD_METRICS + f" SELECT {out(PM, METRIC_DOUBLES, 'days trade_count')} FROM pm")
def _(s, d):
    return period_metrics(s, d).drop("first_date", "last_date")


def ranks(kind: str) -> str:
    if kind == "percent":
        return " + ".join(f"{w} * percent_rank() OVER (PARTITION BY period ORDER BY round({c}, 6) ASC NULLS FIRST)" for c, w in (("cumulative_return", 0.35), ("sharpe_ratio", 0.35), ("max_drawdown", 0.2), ("trade_count", -0.1)))
    one = lambda c: f"CASE WHEN {c} IS NULL THEN NULL ELSE (rank() OVER (PARTITION BY period ORDER BY round({c}, 6) ASC NULLS LAST) + (count({c}) OVER (PARTITION BY period, round({c}, 6)) - 1) / 2) / count({c}) OVER (PARTITION BY period) END"
    return " + ".join(f"{w} * {one(c)}" for c, w in (("cumulative_return", 0.35), ("sharpe_ratio", 0.35), ("max_drawdown", 0.2), ("trade_count", -0.1)))


def rounded_metrics(s, d):
    return rounded(period_metrics(s, d))


@query("WIN21_percent_rank_score", PERIOD_METRICS + f" SELECT strategy_name, symbol, period, round({ranks('percent')}, 6) AS score FROM pm")
def _(s, d):
    return metrics.percent_rank_score(rounded_metrics(s, d), ["period"]).select("strategy_name", "symbol", "period", "score")


@query("WIN22_average_rank_pct_score", PERIOD_METRICS + f" SELECT strategy_name, symbol, period, round({ranks('average')}, 6) AS rank_score FROM pm")
def _(s, d):
    return metrics.average_rank_score(rounded_metrics(s, d), ["period"]).select("strategy_name", "symbol", "period", "rank_score")


@query("JN3_rss_filter_contribution", PERIOD_METRICS + """, j AS (SELECT a.period, a.symbol, round(a.cumulative_return - b.cumulative_return, 9) AS r, round(a.sharpe_ratio - b.sharpe_ratio, 9) AS s, round(a.max_drawdown - b.max_drawdown, 9) AS d FROM pm a JOIN pm b ON a.period = b.period AND a.symbol = b.symbol WHERE a.strategy_name = 'technical_news_filter' AND b.strategy_name = 'moving_average_cross')
SELECT period, symbol, round(r, 6) + 0.0 AS return_delta, round(s, 6) + 0.0 AS sharpe_delta, round(d, 6) + 0.0 AS drawdown_delta, r > 0 AND s >= 0 AND d >= 0 AS adds_value FROM j""")
def _(s, d):
    return metrics.filter_contribution(period_metrics(s, d), "technical_news_filter", "moving_average_cross", ["period", "symbol"]).select("period", "symbol", "return_delta", "sharpe_delta", "drawdown_delta", "adds_value")


@query("AGG7_summarize_by_period", PERIOD_METRICS + " SELECT period, strategy_name, count(DISTINCT symbol)::BIGINT AS symbols, round(avg(cumulative_return), 6) AS mean_return, round(median(cumulative_return), 6) AS median_return, round(min(cumulative_return), 6) AS min_return, count(*) FILTER (cumulative_return > 0)::BIGINT AS positive, round(count(*) FILTER (cumulative_return > 0) / count(*), 6) AS positive_rate FROM pm GROUP BY 1, 2")
def _(s, d):
    return metrics.summarise(period_metrics(s, d), ["period", "strategy_name"])


@query("AGG15_strategy_comparison", FULL + " SELECT strategy_name, round(avg(cumulative_return), 6) AS mean_return, round(avg(sharpe_ratio), 6) AS mean_sharpe, round(avg(max_drawdown), 6) AS mean_drawdown, round(avg(outperformance), 6) AS mean_outperformance, count(DISTINCT symbol)::BIGINT AS assets, sum(trade_count)::BIGINT AS trades FROM fullm GROUP BY 1")
def _(s, d):
    return metrics.strategy_comparison(full(s, d))


@query("SRT4_best_by", FULL + " SELECT symbol, (list(strategy_name ORDER BY round(cumulative_return, 6) DESC, strategy_name))[1] AS best_cumulative_return, (list(strategy_name ORDER BY round(sharpe_ratio, 6) DESC, strategy_name) FILTER (sharpe_ratio IS NOT NULL))[1] AS best_sharpe_ratio FROM fullm GROUP BY 1")
def _(s, d):
    m = rounded(full(s, d))
    return metrics.best_by(m, "symbol", "cumulative_return").join(metrics.best_by(m, "symbol", "sharpe_ratio"), "symbol", "left")


@query("JN7_dashboard_overview", FULL + " SELECT l.symbol, l.date, l.strategy_name, l.signal::BIGINT AS signal, round(f.cumulative_return, 6) AS cumulative_return, f.trade_count::BIGINT AS trade_count FROM (SELECT * FROM sig QUALIFY row_number() OVER (PARTITION BY symbol, strategy_name ORDER BY date DESC) = 1) l LEFT JOIN fullm f USING (strategy_name, symbol)")
def _(s, d):
    latest = latest_per_key(signals(s, d), ["symbol", "strategy_name"], [F.desc("date")]).select("symbol", "date", "strategy_name", "signal")
    return latest.join(full(s, d).select("strategy_name", "symbol", "cumulative_return", "trade_count"), ["strategy_name", "symbol"], "left")


@query("SRT2_worst_drawdowns", DAILY + f", dd AS (SELECT *, round((1 + cumulative_return) / max(1 + cumulative_return) OVER ({WS} ROWS UNBOUNDED PRECEDING) - 1, 6) AS drawdown FROM daily) SELECT strategy_name, symbol, date, drawdown FROM dd ORDER BY drawdown, date, symbol, strategy_name LIMIT 10")
def _(s, d):
    dd = strategies.drawdowns(daily(s, d), 1 + F.col("cumulative_return")).select("strategy_name", "symbol", "date", F.round("drawdown", 6).alias("drawdown"))
    return metrics.ranking(dd.withColumn("depth", -F.col("drawdown")), ["depth"], ["date", "symbol", "strategy_name"], 10).drop("depth")


@query("SRT5_distinct_values", "SELECT DISTINCT o_orderpriority AS symbol FROM orders WHERE o_orderpriority <> ''")
def _(s, d):
    return staging.distinct_values(adapters.read(s, d, "orders").select(F.col("o_orderpriority").alias("symbol")), "symbol")


# ---- indices and exploration

PANEL = GAPPY + """, num AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS pos FROM gap), car AS (SELECT symbol, date, CASE WHEN pos - last(CASE WHEN price IS NOT NULL THEN pos END IGNORE NULLS) OVER b <= 5 THEN last(price IGNORE NULLS) OVER b END AS price FROM num WINDOW b AS (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING)),
panel AS (SELECT * FROM car QUALIFY count(price) OVER (PARTITION BY date) = count(*) OVER (PARTITION BY date))"""


def panel(s, d):
    return index.complete_panel(bars(s, d).select("date", "symbol", (F.col("close") / 7).alias("price")))


@query("JN16_complete_panel", PANEL + f" SELECT {out('symbol date', 'price')} FROM panel")
def _(s, d):
    return panel(s, d).select("symbol", "date", "price")


@query("WIN28_rebase_100", PANEL + f" SELECT symbol, date, round(100 * price / first(price) OVER ({W}), 6) AS level FROM panel")
def _(s, d):
    return index.rebased(panel(s, d)).select("symbol", "date", "level")


@query("WIN29_rolling_vol_panel", PANEL + f", r AS (SELECT *, price / nullif(lag(price) OVER ({W}), 0) - 1 AS r FROM panel) SELECT symbol, date, round(CASE WHEN count(r) OVER ({W} ROWS 59 PRECEDING) >= 20 THEN stddev_samp(r) OVER ({W} ROWS 59 PRECEDING) END, 6) AS volatility FROM r")
def _(s, d):
    return index.rolling_volatility(panel(s, d)).select("symbol", "date", "volatility")


@query("WIN31_rebalance_flags", PANEL + " SELECT date, coalesce(date_trunc('quarter', date) <> lag(date_trunc('quarter', date)) OVER (ORDER BY date), true) AS rebalance FROM (SELECT DISTINCT date FROM panel)")
def _(s, d):
    return index.rebalance_flags(panel(s, d))


@query("WIN32_target_weights", PANEL + f", r AS (SELECT *, price / nullif(lag(price) OVER ({W}), 0) - 1 AS r FROM panel), v AS (SELECT *, CASE WHEN count(r) OVER ({W} ROWS 59 PRECEDING) >= 20 THEN stddev_samp(r) OVER ({W} ROWS 59 PRECEDING) END AS v FROM r), k AS (SELECT *, lag(v) OVER ({W}) AS k FROM v) SELECT symbol, date, round(1 / k / sum(1 / k) OVER (PARTITION BY date), 6) AS weight FROM k WHERE k IS NOT NULL")
def _(s, d):
    return index.target_weights(index.rolling_volatility(panel(s, d)), "inverse_volatility").select("symbol", "date", "weight")


@query("WIN33_cap_weights", """WITH RECURSIVE w AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS symbol, sum(o_totalprice) / sum(sum(o_totalprice)) OVER (PARTITION BY CAST(o_orderdate AS DATE)) AS weight FROM orders GROUP BY 1, 2 QUALIFY count(*) OVER (PARTITION BY CAST(o_orderdate AS DATE)) = 5),
it AS (SELECT date, symbol, weight, 0 AS i FROM w UNION ALL SELECT date, symbol, CASE WHEN weight >= 0.3 THEN 0.3 ELSE weight * (1 - 0.3 * count(*) FILTER (weight >= 0.3) OVER (PARTITION BY date)) / sum(weight) FILTER (weight < 0.3) OVER (PARTITION BY date) END, i + 1 FROM it WHERE i < 6)
SELECT date, symbol, round(weight, 6) AS weight FROM it WHERE i = 6""")
def _(s, d):
    t = adapters.read(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("symbol")).agg(F.sum("o_totalprice").alias("v"))
    by = Window.partitionBy("date")
    w = t.withColumns({"weight": F.col("v") / F.sum("v").over(by), "n": F.count("*").over(by)}).where("n = 5").select("date", "symbol", "weight")
    return index.capped(w, 0.3)


@query("WIN34_synthetic_index", "WITH RECURSIVE " + PANEL.removeprefix("WITH ") + """, days AS (SELECT date, row_number() OVER (ORDER BY date) AS t, coalesce(date_trunc('year', date) <> lag(date_trunc('year', date)) OVER (ORDER BY date), true) AS go FROM (SELECT DISTINCT date FROM panel)),
ps AS (SELECT t, go, date, list(price ORDER BY symbol) AS p FROM panel JOIN days USING (date) GROUP BY ALL),
rec AS (SELECT t, date, go, p, list_transform(p, lambda x: 100.0 / len(p) / x) AS u, 100.0::DOUBLE AS gross, 100.0::DOUBLE AS level, 1.0::DOUBLE AS turnover FROM ps WHERE t = 1
UNION ALL SELECT t, date, go, p, CASE WHEN go THEN list_transform(p, lambda x: net / len(p) / x) ELSE u END, gross, CASE WHEN go THEN net ELSE gross END, CASE WHEN go THEN turn ELSE 0.0 END
FROM (SELECT *, gross * (1 - turn * 10 / 1e4) AS net FROM (SELECT *, list_sum(list_transform(list_zip(u, p), lambda z: abs(1.0 / len(p) - z[1] * z[2] / gross))) / 2 AS turn FROM (SELECT ps.t, ps.date, ps.go, ps.p, rec.u, list_sum(list_transform(list_zip(rec.u, ps.p), lambda z: z[1] * z[2])) AS gross FROM rec JOIN ps ON ps.t = rec.t + 1))))
SELECT date, round(gross, 6) AS gross_level, round(level, 6) AS level, round(turnover, 6) AS turnover, go AS rebalance_executed FROM rec""")
def _(s, d):
    return index.rebalanced_index(panel(s, d), "year")


LEVELS = PANEL + f", lev AS (SELECT symbol, date, 100 * price / first(price) OVER ({W}) AS level FROM panel)"


@query("AGG13_series_metrics", LEVELS + f""", r AS (SELECT *, level / lag(level) OVER ({W}) - 1 AS r, level / max(level) OVER ({W} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM lev)
SELECT symbol, min(date) AS start_date, max(date) AS end_date, count(level)::BIGINT AS n, round(arg_max(level, date) / arg_min(level, date) - 1, 6) AS total_return, round(pow(arg_max(level, date) / arg_min(level, date), 365.25 / date_diff('day', min(date), max(date))) - 1, 6) AS cagr,
round(stddev_samp(r) * sqrt(252), 6) AS volatility, round(avg(r) * sqrt(252) / stddev_samp(r), 6) AS sharpe, round(min(dd), 6) AS max_drawdown, count(*) FILTER (level <= 0)::BIGINT AS non_positive FROM r GROUP BY 1""")
def _(s, d):
    return metrics.series_metrics(index.rebased(panel(s, d)), "symbol", "level")


@query("AGG16_return_distribution", RET + " SELECT symbol, count(simple_return)::BIGINT AS n, round(avg(simple_return), 6) AS mean, round(stddev_samp(simple_return), 6) AS std, round(min(simple_return), 6) AS min, round(max(simple_return), 6) AS max, " + ", ".join(f"round(quantile_cont(simple_return, {p}), 6) AS p{round(p * 100):02d}" for p in (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)) + " FROM ret GROUP BY 1")
def _(s, d):
    return metrics.return_distribution(indicators.returns(bars(s, d)))


@query("AGG17_correlation_matrix", RET + " SELECT a.symbol AS symbol_a, b.symbol AS symbol_b, round(corr(a.simple_return, b.simple_return), 6) AS correlation, count(*)::BIGINT AS n FROM ret a JOIN ret b USING (date) WHERE a.symbol <= b.symbol AND a.simple_return IS NOT NULL AND b.simple_return IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    return metrics.correlations(indicators.returns(bars(s, d)))


@query("AGG18_monthly_seasonality", BARS + ", e AS (SELECT symbol, date_trunc('month', date) AS m, arg_max(close, date) AS c FROM bars GROUP BY 1, 2), r AS (SELECT symbol, month(m) AS month, c / lag(c) OVER (PARTITION BY symbol ORDER BY m) - 1 AS r FROM e) SELECT symbol, month::BIGINT AS month, round(avg(r), 6) AS mean_return, round(median(r), 6) AS median_return, round(count(*) FILTER (r > 0) / count(*), 6) AS positive_rate, count(*)::BIGINT AS n FROM r WHERE r IS NOT NULL GROUP BY 1, 2")
def _(s, d):
    return metrics.monthly_seasonality(bars(s, d))


@query("AGG19_annual_returns", BARS + ", e AS (SELECT symbol, year(date) AS year, arg_max(close, date) AS l, arg_min(close, date) AS f FROM bars GROUP BY 1, 2) SELECT symbol, year::BIGINT AS year, round(l / coalesce(lag(l) OVER (PARTITION BY symbol ORDER BY year), f) - 1, 6) AS annual_return FROM e")
def _(s, d):
    return metrics.annual_returns(bars(s, d))


@query("AGG20_coverage_check", GAPPY + " SELECT symbol, round(avg((price IS NOT NULL)::INT), 6) AS coverage FROM gap GROUP BY 1 HAVING avg((price IS NOT NULL)::INT) < 0.72")
def _(s, d):
    return cleaning.coverage(gappy(s, d), "symbol", "price", 0.72)


@query("WIN30_rolling_relative_performance", LEVELS + f", ix AS (SELECT date, avg(level) AS level FROM lev GROUP BY 1), a AS (SELECT symbol, date, level / lag(level, 252) OVER ({W}) - 1 AS own FROM lev), b AS (SELECT date, level / lag(level, 252) OVER (ORDER BY date) - 1 AS of FROM ix) SELECT symbol, date, round(own - of, 6) AS relative_return FROM a JOIN b USING (date) WHERE own - of IS NOT NULL")
def _(s, d):
    levels = index.rebased(panel(s, d))
    return metrics.rolling_relative(levels, levels.groupBy("date").agg(F.avg("level").alias("level")))


@query("WIN39_ledger_fold")
def _(s, d):
    return ledger.ledger(signals(s, d))


@query("AGG9_ledger_summary")
def _(s, d):
    return ledger.summary(ledger.ledger(signals(s, d)))


# ---- data quality


@query("DQ1_fresh_market_data", "SELECT max(CAST(o_orderdate AS DATE)) AS last_date FROM orders HAVING max(CAST(o_orderdate AS DATE)) < DATE '2002-01-01' - 7")
def _(s, d):
    return cleaning.stale(bars(s, d), F.lit("2002-01-01").cast("date"))


@query("DQ3_no_future_dates", BARS + " SELECT symbol, date FROM bars WHERE date > DATE '2001-07-01'")
def _(s, d):
    return cleaning.after(bars(s, d), F.lit("2001-07-01").cast("date")).select("symbol", "date")


@query("DQ4_ohlc_consistency", RET + " SELECT symbol, date FROM (SELECT symbol, date, previous_close AS open, high, low, close FROM ret) WHERE (open IS NOT NULL AND (high < greatest(open, low, close) OR low > least(open, high, close))) OR close IS NULL")
def _(s, d):
    return cleaning.ohlc_inconsistent(indicators.returns(bars(s, d)).withColumn("open", F.col("previous_close"))).select("symbol", "date")


@query("DQ6_valid_signals", SIGNALS + " SELECT strategy_name, count(*)::BIGINT AS n FROM (SELECT strategy_name, signal + CASE WHEN symbol = '5-LOW' THEN 1 ELSE -1 END AS signal FROM sig) WHERE signal NOT IN (-1, 0, 1) GROUP BY 1")
def _(s, d):
    moved = signals(s, d).withColumn("signal", F.col("signal") + F.when(F.col("symbol") == "5-LOW", 1).otherwise(-1))  # so that some are out of range
    return cleaning.not_accepted(moved, "signal", [-1, 0, 1]).groupBy("strategy_name").agg(F.count("*").alias("n"))


@query("DQ7_unique_combination", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(s, d):
    return cleaning.duplicates(adapters.read(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])
