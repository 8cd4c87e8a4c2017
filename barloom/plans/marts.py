"""Registered queries over staged tables, benchmarks and curves, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.operators import cleaning, index, indicators, metrics, news, portfolio, staging, strategies
from barloom.operators.windows import fill_forward
from barloom.plans import story
from barloom.plans.market import BARS, DAILY, FULL, GAPPY, LEVELS, PANEL, SIGNALS, TECH, W, bars, daily, full, gappy, out, panel, query, rounded, signals, tech
from barloom.plans.story import STORY
from barloom.sources import adapters

BENCH = """WITH raw AS (SELECT CAST(l_shipdate AS DATE) AS date, CASE WHEN l_returnflag = 'R' THEN 'synthetic_commodity_index' ELSE l_returnflag END AS benchmark_id, CASE WHEN l_linestatus = 'O' THEN 'synthetic' ELSE 'buy_and_hold' END AS benchmark_type,
  nullif(l_linenumber::VARCHAR, '1') AS component_id, l_extendedprice AS benchmark_level, l_discount - 0.05::DOUBLE AS daily_return, l_orderkey AS ingested_at FROM lineitem),
stg AS (SELECT * FROM raw QUALIFY row_number() OVER (PARTITION BY date, benchmark_id, coalesce(component_id, '') ORDER BY ingested_at DESC, benchmark_level, benchmark_type, component_id NULLS FIRST, daily_return) = 1)"""
MARKET = "(component_id IS NULL OR benchmark_type IN ('synthetic', 'synthetic_index', 'global') OR benchmark_id IN ('synthetic_commodity_index', 'global_commodities'))"
PICK = BENCH + f", pick AS (SELECT * FROM stg WHERE {MARKET} QUALIFY row_number() OVER (PARTITION BY date ORDER BY CASE WHEN benchmark_id = 'synthetic_commodity_index' THEN 1 WHEN component_id IS NULL THEN 2 ELSE 3 END, benchmark_id, benchmark_level, benchmark_type, component_id NULLS FIRST, daily_return) = 1)"


def staged(s, d):
    return staging.benchmarks(adapters.raw_benchmarks(s, d))


def picked(s, d):
    return portfolio.benchmark_pick(staged(s, d).select("date", "benchmark_id", "benchmark_type", "component_id", "benchmark_level", "daily_return"))


@query("PRJ2_stg_benchmarks", BENCH + f" SELECT date, benchmark_id, benchmark_type, component_id, {out('', 'benchmark_level daily_return')} FROM stg")
def _(s, d):
    return staged(s, d).select("date", "benchmark_id", "benchmark_type", "component_id", "benchmark_level", "daily_return")


@query("CLN9_clean_benchmarks", BENCH + f" SELECT date, benchmark_id, benchmark_type, component_id, {out('', 'benchmark_level daily_return')} FROM stg")
def _(s, d):
    return staging.clean_benchmarks(adapters.raw_benchmarks(s, d), F.unix_timestamp("ingested_at")).select("date", "benchmark_id", "benchmark_type", "component_id", "benchmark_level", "daily_return")


def raw_news(s, d):
    i = F.col("doc_id")
    at = lambda start: F.timestamp_seconds(F.lit(start) + i * 7000)
    first = adapters.read(s, d, "documents").select(i.cast("string").alias("article_id"), F.col("source").alias("source_id"), F.substring("text", 1, 40).alias("title"), F.when(i % 7 > 0, at(1_700_000_000)).alias("published_at"), F.when(i % 3 > 0, at(1_700_100_000)).alias("fetched_at"), at(1_700_200_000).alias("ingested_at"))
    again = first.withColumns({"ingested_at": F.timestamp_seconds(F.unix_timestamp("ingested_at") + 60), "published_at": F.lit(None).cast("timestamp")})
    return first.unionByName(again.where("cast(article_id AS bigint) % 2 = 0"))  # the even ones were ingested again, without a date


@query("PRJ3_stg_news", """WITH a AS (SELECT doc_id, source AS source_id, substr(text, 1, 40) AS title, CASE WHEN doc_id % 7 > 0 AND doc_id % 2 = 1 THEN 1700000000 WHEN doc_id % 3 > 0 THEN 1700100000 WHEN doc_id % 2 = 0 THEN 1700200060 ELSE 1700200000 END + doc_id * 7000 AS t FROM documents)
SELECT doc_id::VARCHAR AS article_id, source_id, title, t::BIGINT AS published, (DATE '1970-01-01' + CAST(t // 86400 AS INT)) AS published_date FROM a WHERE title IS NOT NULL""")
def _(s, d):
    return staging.news(raw_news(s, d)).select("article_id", "source_id", "title", F.unix_timestamp("published_at").alias("published"), "published_date")


@query("PRJ4_stg_embeddings", "SELECT vec_id::VARCHAR AS article_id, len(embedding)::BIGINT AS embedding_dimension, 'mean' AS embedding_model FROM embeddings WHERE embedding IS NOT NULL")
def _(s, d):
    raw = adapters.vectors(s, d).select("article_id", "embedding", F.size("embedding").alias("embedding_dimension"), F.lit("mean").alias("embedding_model"))
    return staging.embeddings(raw).select("article_id", "embedding_dimension", "embedding_model")


@query("PRJ5_stg_sentiment", "WITH " + STORY + " SELECT article_id::VARCHAR AS article_id, round(sentiment_score, 6) + 0.0 AS sentiment_score, round(novelty_score, 6) AS novelty_score FROM feel")
def _(s, d):
    return staging.sentiment(adapters.story_sentiment(s, d)).select("article_id", "sentiment_score", "novelty_score")


@query("PRJ6_stg_relevance", "WITH " + STORY + f" SELECT article_id::VARCHAR AS article_id, topic_id AS commodity_id, round(similarity_score, 6) + 0.0 AS similarity_score, similarity_score >= {story.THRESHOLD} AS is_relevant FROM rel")
def _(s, d):
    return staging.relevance(story.relevance(s, d).withColumnRenamed("topic_id", "commodity_id")).select("article_id", "commodity_id", "similarity_score", "is_relevant")


LOGS = "WITH lg AS (SELECT user_id::VARCHAR AS run_id, event_type AS task_name, CASE WHEN value > 60 THEN 'failed' WHEN event_id % 9 = 0 THEN 'skipped' ELSE 'success' END AS status, value AS duration_seconds, event_id % 100 AS rows_processed FROM events)"


@query("PRJ7_stg_pipeline_logs", LOGS + " SELECT run_id, task_name, status, round(duration_seconds, 6) AS duration_seconds, rows_processed::BIGINT AS rows_processed FROM lg WHERE run_id IS NOT NULL AND task_name IS NOT NULL")
def _(s, d):
    return staging.logs(adapters.raw_logs(s, d)).select("run_id", "task_name", "status", "duration_seconds", "rows_processed")


@query("AGG21_pipeline_run_status", LOGS + """ SELECT run_id, CASE WHEN bool_and(status IN ('success', 'skipped')) THEN 'success' ELSE 'failed' END AS status, round(sum(duration_seconds), 4) AS duration_seconds, sum(rows_processed)::BIGINT AS rows_processed,
  array_to_string(list_sort(list_distinct(list(task_name) FILTER (status = 'failed'))), ', ') AS error_message FROM lg WHERE task_name IS NOT NULL AND run_id IS NOT NULL GROUP BY 1""")
def _(s, d):
    return staging.run_status(staging.logs(adapters.raw_logs(s, d))).withColumn("duration_seconds", F.round("duration_seconds", 4))


@query("PRJ8_mart_strategy_signals", SIGNALS + " SELECT strategy_name, symbol, date, round(close, 6) AS close, signal::BIGINT AS signal FROM sig")
def _(s, d):
    return signals(s, d).select("strategy_name", "symbol", "date", "close", "signal")


@query("PRJ9_news_features_typed", "WITH " + STORY + " SELECT topic_id AS commodity_id, date, news_volume::BIGINT AS news_volume, round(weighted_sentiment_score, 6) + 0.0 AS weighted_sentiment_score, round(news_surprise, 6) + 0.0 AS news_surprise_20d FROM feat")
def _(s, d):
    types = {"commodity_id": "string", "date": "date", "news_volume": "bigint", "weighted_sentiment_score": "double", "news_surprise_20d": "double"}
    return staging.typed(story.features(s, d).withColumnsRenamed({"topic_id": "commodity_id", "news_surprise": "news_surprise_20d"}), types, ["commodity_id", "date"])


@query("PRJ10_drop_columns", "SELECT * EXCLUDE (o_totalprice, o_orderdate) FROM orders")
def _(s, d):
    return adapters.read(s, d, "orders").drop("o_totalprice", "o_orderdate")


@query("SRC7_landing_views", "SELECT l_returnflag, count(*)::BIGINT AS n, max(o_orderkey)::BIGINT AS top FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1")
def _(s, d):
    staging.landing_views(s, {t: adapters.read(s, d, t) for t in ("orders", "lineitem")})
    return s.sql("SELECT l_returnflag, count(*) AS n, max(o_orderkey) AS top FROM landing_lineitem JOIN landing_orders ON l_orderkey = o_orderkey GROUP BY 1")


@query("SRC8_reference_dim", "SELECT p_partkey AS symbol, p_name AS name, 'https://news.example.com/search?q=' || replace(url_encode(p_name || ' price'), '%20', '+') AS news_url FROM part")
def _(s, d):
    return staging.reference_dim(adapters.read(s, d, "part").select(F.col("p_partkey").alias("symbol"), F.col("p_name").alias("name")))


@query("FLT3_select_universe", "SELECT s_suppkey AS symbol, 'p' || s_nationkey % 3 AS priority FROM supplier WHERE s_acctbal > 0 AND s_nationkey % 3 < 2")
def _(s, d):
    dim = adapters.read(s, d, "supplier").select(F.col("s_suppkey").alias("symbol"), F.concat(F.lit("p"), (F.col("s_nationkey") % 3).cast("string")).alias("priority"), "s_acctbal")
    return staging.universe(dim, F.col("s_acctbal") > 0, ["p0", "p1"]).drop("s_acctbal")


@query("DQ12_validate_universe", "SELECT 'phone' AS \"column\", NULL::VARCHAR AS value, 'missing' AS problem FROM supplier WHERE s_suppkey % 10 = 3 UNION ALL SELECT 'nation', s_nationkey::VARCHAR, 'not unique' FROM supplier GROUP BY s_nationkey HAVING count(*) > 1")
def _(s, d):
    dim = adapters.read(s, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 10 != 3, "x").alias("phone"), F.col("s_nationkey").alias("nation"))
    return cleaning.universe_errors(dim, ["s_suppkey", "phone"], ["s_suppkey", "nation"])


@query("DQ9_unique", "SELECT o_custkey, count(*)::BIGINT AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return cleaning.not_unique(adapters.read(s, d, "orders"), "o_custkey")


@query("DQ5_indicator_ranges", TECH + " SELECT symbol, date FROM (SELECT *, rsi_14 * 1.25 AS r FROM tech) WHERE r < 0 OR r > 100 OR stochastic_rsi_k NOT BETWEEN 0 AND 100 OR stochastic_rsi_d NOT BETWEEN 0 AND 100 OR volatility_20d < 0 OR volume_ratio_20d < 0")
def _(s, d):
    t = tech(s, d)
    return cleaning.indicator_out_of_range(t.withColumn("rsi_14", F.col("rsi_14") * 1.25)).select("symbol", "date")  # stretched, so that some leave the range


RAWQ = "WITH q AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS open, CASE WHEN o_orderkey % 11 = 0 THEN -1 ELSE o_totalprice * 1.01 END AS high, o_totalprice * 1.02 AS low, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_totalprice END AS close, o_orderkey AS seq FROM orders)"


def quotes(s, d):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    null = F.lit(None).cast("double")
    return adapters.read(s, d, "orders").select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date"), F.when(k % 5 != 0, p).alias("open"), F.when(k % 11 == 0, -1.0).otherwise(p * 1.01).alias("high"), (p * 1.02).alias("low"), F.when(k % 13 != 0, p).alias("close"), null.alias("adjusted_close"), null.alias("volume"), null.alias("dividends"), k.alias("seq"))


@query("CLN2_clean_equity", RAWQ + """, l AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY seq DESC, close NULLS FIRST, high, low, open NULLS FIRST) = 1)
SELECT symbol, date, round(greatest(open, high, low, close), 4) AS high, round(least(open, high, low, close), 4) AS low, round(close, 4) AS adjusted_close, 0.0::DOUBLE AS dividends FROM l WHERE close IS NOT NULL AND least(open, high, low, close) > 0""")
def _(s, d):
    return cleaning.clean_equity(quotes(s, d), F.col("seq")).select("symbol", "date", F.round("high", 4).alias("high"), F.round("low", 4).alias("low"), F.round("adjusted_close", 4).alias("adjusted_close"), "dividends")


@query("CLN7_fill_from_close", RAWQ + " SELECT seq, symbol, date, round(coalesce(open, close), 4) AS open, round(close, 4) AS close FROM q")
def _(s, d):
    return cleaning.fill_from_close(quotes(s, d)).select("seq", "symbol", "date", F.round("open", 4).alias("open"), F.round("close", 4).alias("close"))


@query("CLN11_ticker_validation", RAWQ + ", u AS (SELECT DISTINCT symbol FROM q UNION SELECT 'NONE') SELECT u.symbol, count(close)::BIGINT AS rows, min(date) FILTER (close IS NOT NULL) AS first_date, max(date) FILTER (close IS NOT NULL) AS last_date, count(close) >= 60 AS valid FROM u LEFT JOIN q USING (symbol) GROUP BY 1")
def _(s, d):
    q = quotes(s, d)
    return cleaning.ticker_validation(q.select("symbol").union(q.agg(F.lit("NONE"))), q, 60)


@query("CLN12_panel_asset_metadata", GAPPY + """, num AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS pos FROM gap), car AS (SELECT *, last(CASE WHEN price IS NOT NULL THEN pos END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS pos0 FROM num)
SELECT symbol, count(*)::BIGINT AS rows, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (price IS NULL AND (pos0 IS NULL OR pos - pos0 > 1))::BIGINT AS missing, 0::BIGINT AS non_positive, count(*) FILTER (price IS NULL AND pos0 IS NOT NULL AND pos - pos0 <= 1)::BIGINT AS carried, length(symbol)::BIGINT AS width FROM car GROUP BY symbol""")
def _(s, d):
    filled = fill_forward(gappy(s, d), "price", ["symbol"], 1)
    dim = bars(s, d).select("symbol").distinct().withColumn("width", F.length("symbol"))
    return portfolio.asset_metadata(filled, "price_filled", dim)


# ---- benchmarks and curves


@query("AGG1_synthetic_index_asset", BENCH + " SELECT 'COMMODITY_INDEX' AS symbol, date, round(max(benchmark_level), 6) AS close FROM stg WHERE benchmark_id = 'synthetic_commodity_index' AND benchmark_level IS NOT NULL GROUP BY date")
def _(s, d):
    return portfolio.index_asset(staged(s, d)).select("symbol", "date", "close")


@query("SET1_tradable_assets", BENCH + BARS.replace("WITH bars", ", bars") + " SELECT symbol, date, round(close, 6) AS close, volume FROM bars UNION ALL SELECT 'COMMODITY_INDEX', date, round(max(benchmark_level), 6), NULL FROM stg WHERE benchmark_id = 'synthetic_commodity_index' GROUP BY date")
def _(s, d):
    return portfolio.tradable_assets(bars(s, d), staged(s, d)).select("symbol", "date", "close", "volume")


@query("WIN24_priority_pick", PICK + f" SELECT date, benchmark_id, component_id, {out('', 'benchmark_level daily_return')} FROM pick")
def _(s, d):
    return picked(s, d).select("date", "benchmark_id", "component_id", "benchmark_level", "daily_return")


@query("JN5_benchmark_by_date", PICK.replace("WITH raw", "WITH RECURSIVE raw") + SIGNALS.replace("WITH bars", ", bars").replace("raw AS", "raw AS") + """, g AS (SELECT date, exp(sum(ln(greatest(1 + daily_return, 1e-6))) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS benchmark_return FROM (SELECT date, avg(daily_return) AS daily_return FROM stg WHERE component_id IS NULL GROUP BY date))
SELECT strategy_name, symbol, date, signal::BIGINT AS signal, round(log(1 + benchmark_return), 4) + 0.0 AS log_benchmark FROM sig LEFT JOIN g USING (date)""")
def _(s, d):
    curve = metrics.benchmark_curve(metrics.benchmark_daily(staged(s, d), F.col("component_id").isNull()))
    return portfolio.with_benchmark(signals(s, d).select("strategy_name", "symbol", "date", "signal"), curve).select("strategy_name", "symbol", "date", "signal", F.round(F.log10(1 + F.col("benchmark_return")), 4).alias("log_benchmark"))


CURVES = DAILY + PICK.replace("WITH raw", ", raw") + """, cur0 AS (SELECT symbol, 'strategy' AS series_type, strategy_name AS series_name, date, net_return AS r FROM daily UNION ALL SELECT symbol, 'buy_hold', 'Buy & Hold', date, simple_return FROM daily WHERE strategy_name = 'buy_and_hold'
  UNION ALL SELECT symbol, 'benchmark', 'Index', date, p.daily_return FROM daily JOIN pick p USING (date) WHERE strategy_name = 'buy_and_hold'),
cur AS (SELECT *, 100000 * exp(sum(ln(1 + coalesce(r, 0))) OVER (PARTITION BY symbol, series_type, series_name ORDER BY date ROWS UNBOUNDED PRECEDING)) AS equity FROM cur0)"""


@query("WIN38_portfolio_curves", CURVES + " SELECT symbol, series_type, series_name, date, round(log10(equity), 5) AS log_equity FROM cur")
def _(s, d):
    return portfolio.portfolio_curves(daily(s, d), picked(s, d)).select("symbol", "series_type", "series_name", "date", F.round(F.log10("equity"), 5).alias("log_equity"))


@query("AGG14_curve_metrics", CURVES + """, e AS (SELECT *, coalesce(equity / lag(equity) OVER w - 1, 0) AS x, equity / max(equity) OVER (w ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM cur WINDOW w AS (PARTITION BY symbol, series_type, series_name ORDER BY date)),
m AS (SELECT symbol, series_type, series_name, min(date) AS start_date, max(date) AS end_date, arg_max(equity, date) / 100000 - 1 AS ret, stddev_samp(x) * sqrt(252) AS vol, avg(x) * sqrt(252) / stddev_samp(x) AS sharpe, min(dd) AS dd FROM e GROUP BY 1, 2, 3),
t AS (SELECT symbol, strategy_name AS series_name, count(*) AS n FROM daily WHERE position_change > 0 GROUP BY 1, 2), b AS (SELECT symbol, max(ret) FILTER (series_type = 'buy_hold') AS h FROM m GROUP BY 1)
SELECT symbol, series_type, series_name, start_date, end_date, round(log10(greatest(1 + ret, 1e-9)), 5) + 0.0 AS log_return, round(vol, 5) AS annualized_volatility, round(sharpe, 5) + 0.0 AS sharpe_ratio, round(dd, 5) + 0.0 AS max_drawdown,
  CASE WHEN series_type = 'strategy' THEN coalesce(n, 0) ELSE 0 END::BIGINT AS trade_count, ret > h AS beats_holding FROM m LEFT JOIN t USING (symbol, series_name) JOIN b USING (symbol)""")
def _(s, d):
    day = daily(s, d)
    m = portfolio.curve_metrics(portfolio.portfolio_curves(day, picked(s, d)), strategies.trades(day))
    five = lambda c: (F.round(c, 5) + F.lit(0.0)).alias(c)
    return m.select("symbol", "series_type", "series_name", "start_date", "end_date", F.round(F.log10(F.greatest(1 + F.col("cumulative_return"), F.lit(1e-9))), 5).alias("log_return"), five("annualized_volatility"), five("sharpe_ratio"), five("max_drawdown"), "trade_count", (F.col("outperformance_vs_buy_hold") > 0).alias("beats_holding"))


@query("JN2_technical_join_news", SIGNALS + " SELECT symbol, date, round(close, 6) AS close, news_volume::BIGINT AS news_volume, round(weighted_sentiment_score, 6) + 0.0 AS weighted_sentiment_score, round(supply_shock_score, 6) + 0.0 AS supply_shock_score FROM tn")
def _(s, d):
    joined = news.with_news(indicators.technical(bars(s, d)), story.features(s, d))
    return joined.select("symbol", "date", "close", "news_volume", "weighted_sentiment_score", "supply_shock_score")


@query("JN8_signals_to_prices", SIGNALS + " SELECT b.symbol, b.date, coalesce(signal, 0)::BIGINT AS signal, CASE WHEN signal IS NULL THEN 'missing_signal' ELSE 'rule' END AS reason FROM bars b LEFT JOIN (SELECT * FROM sig WHERE strategy_name = 'breakout_20d' AND symbol <> '5-LOW') s USING (symbol, date)")
def _(s, d):
    some = staging.matching(signals(s, d), strategy_name="breakout_20d").where("symbol <> '5-LOW'").withColumn("reason", F.lit("rule"))
    return portfolio.signals_to_prices(bars(s, d).select("symbol", "date"), some)


INDEX = LEVELS + ", ix AS (SELECT date, avg(level) AS level FROM lev GROUP BY 1)"


def mean_index(levels):
    return levels.groupBy("date").agg(F.avg("level").alias("level"))


@query("JN17_comparison", INDEX + " SELECT date, symbol, round(level, 4) AS level FROM lev UNION ALL SELECT date, 'INDEX', round(level, 4) FROM ix")
def _(s, d):
    levels = index.rebased(panel(s, d))
    return portfolio.comparison(mean_index(levels), levels).withColumn("level", F.round("level", 4))


@query("RUL10_benchmark_rows", INDEX + """, r AS (SELECT date, 'buy_hold_' || lower(symbol) AS benchmark_id, 'buy_and_hold' AS benchmark_type, symbol AS component_id, level FROM lev UNION ALL SELECT date, 'synthetic_commodity_index', 'synthetic_index', NULL, level FROM ix)
SELECT date, benchmark_id, benchmark_type, component_id, round(level, 4) AS benchmark_level, round(level / lag(level) OVER w - 1, 6) + 0.0 AS daily_return, round(level / max(level) OVER (w ROWS UNBOUNDED PRECEDING) - 1, 6) + 0.0 AS drawdown FROM r WINDOW w AS (PARTITION BY benchmark_id ORDER BY date)""")
def _(s, d):
    levels = index.rebased(panel(s, d))
    return portfolio.benchmark_rows(levels, mean_index(levels)).withColumn("benchmark_level", F.round("benchmark_level", 4))


@query("JN18_master_dataset", INDEX + f""" SELECT p.symbol, p.date, round(price, 6) AS price, round(l.level, 4) AS asset_level, round(l.level / lag(l.level) OVER (PARTITION BY p.symbol ORDER BY p.date) - 1, 6) + 0.0 AS asset_return, round(ix.level, 4) AS index_level, length(p.symbol)::BIGINT AS width FROM panel p LEFT JOIN lev l USING (symbol, date) LEFT JOIN ix ON ix.date = p.date""")
def _(s, d):
    p = panel(s, d)
    levels = index.rebased(p)
    dim = bars(s, d).select("symbol").distinct().withColumn("width", F.length("symbol"))
    m = portfolio.master(levels, p, mean_index(levels), dim)
    return m.select("symbol", "date", "price", F.round("asset_level", 4).alias("asset_level"), "asset_return", F.round("index_level", 4).alias("index_level"), "width")


@query("JN19_metadata_lookup", "SELECT o_orderkey, c_name, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def _(s, d):
    people = adapters.read(s, d, "customer").join(adapters.read(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return adapters.read(s, d, "orders").join(people, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name", "n_name")


@query("SET3_stack_results", FULL + " SELECT strategy_name, symbol, round(cumulative_return, 6) + 0.0 AS cumulative_return, trade_count::BIGINT AS trade_count FROM fullm UNION ALL SELECT NULL, symbol, round(max(close) / min(close), 6), NULL FROM bars GROUP BY symbol")
def _(s, d):
    span = bars(s, d).groupBy("symbol").agg((F.max("close") / F.min("close")).alias("cumulative_return"))
    return portfolio.stacked([full(s, d).select("strategy_name", "symbol", "cumulative_return", "trade_count"), span])


@query("AGG11_compare_results", FULL + " SELECT strategy_name, symbol, round(outperformance, 6) + 0.0 AS outperformance, round(sharpe_ratio, 6) + 0.0 AS sharpe_ratio, round(cumulative_return, 6) + 0.0 AS cumulative_return FROM fullm")
def _(s, d):
    m = rounded(full(s, d)).select("strategy_name", "symbol", "outperformance", "sharpe_ratio", "cumulative_return")
    return metrics.ranking(m, ["outperformance", "sharpe_ratio", "cumulative_return"], ["strategy_name", "symbol"])


@query("SRT3_ranking_by_metric", FULL + " SELECT strategy_name, symbol, round(sharpe_ratio, 6) + 0.0 AS sharpe_ratio FROM fullm WHERE sharpe_ratio IS NOT NULL")
def _(s, d):
    return metrics.ranking(rounded(full(s, d)).select("strategy_name", "symbol", "sharpe_ratio").where("sharpe_ratio IS NOT NULL"), ["sharpe_ratio"], ["strategy_name", "symbol"])


@query("SRT1_order_limit", "SELECT event_id, event_type FROM events ORDER BY ts DESC NULLS LAST, event_id LIMIT 5000")
def _(s, d):
    return metrics.ranking(adapters.read(s, d, "events"), ["ts"], ["event_id"], 5000).select("event_id", "event_type")
