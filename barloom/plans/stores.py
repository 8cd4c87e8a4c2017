"""Registered queries of stored tables and files: what is written is what is read; benchmark rows, models, overview and scalars."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import text as tx
from barloom.operators import cleaning, index, metrics, portfolio, staging, strategies
from barloom.plans.batch import FAULTS, MARKET_CURVE, RECURSION, faulty
from barloom.plans.market import BARS, FULL, LEVELS, PANEL, bars, out, panel, query, signals
from barloom.plans.marts import staged
from barloom.plans.story import STORY
from barloom.sources import adapters, tables
from barloom.sources.scratch import checkpoint_dir, stored


def folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- files and tables

ARTICLE = T.StructType([T.StructField("article_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("title", "clean_text", "source"))])


@query("SRC3_scan_articles", """SELECT doc_id AS article_id, md5(text) AS text_hash, length(text)::BIGINT AS n_chars, source FROM documents
WHERE doc_id IS NOT NULL AND string_split(text, chr(10))[1] <> ''""")
def scan_articles(s, d):
    """Whole documents written as CSV and read back, quotes, line breaks and outer blanks included. Articles without a title, here the first line, are left out."""
    path = folder(s, "articles")
    docs = adapters.read(s, d, "documents")
    tables.write_csv(docs.select(F.col("doc_id").alias("article_id"), F.split("text", "\n")[0].alias("title"), F.col("text").alias("clean_text"), "source"), path)
    back = tables.scan_csv(s, path, ARTICLE, ("article_id", "title", "clean_text"))
    return back.select("article_id", F.md5(F.encode("clean_text", "UTF-8")).alias("text_hash"), F.length("clean_text").alias("n_chars"), "source")


STORED = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("price", T.DoubleType()), T.StructField("note", T.StringType()), T.StructField("year", T.IntegerType())])


def priced_orders(s, d):
    return adapters.read(s, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), F.year("o_orderdate").alias("year"))


@query("SNK1_append_aligned", """SELECT o_orderkey, round(o_totalprice, 6) AS price, CASE WHEN o_orderkey % 2 = 0 THEN 'even' END AS note, year(CAST(o_orderdate AS DATE))::BIGINT AS year FROM orders""")
def append_aligned(s, d):
    """A table is made where there is none, then two loads are brought to its schema and appended: one with a note, one whose numbers are text and whose columns stand in another order."""
    path, o = folder(s, "appended"), priced_orders(s, d)
    if not tables.ensure_table(s, path, STORED, ["year"]) or tables.ensure_table(s, path, STORED, ["year"]):
        raise RuntimeError("a table is made once")
    even = o.where("o_orderkey % 2 = 0").withColumn("note", F.lit("even"))
    odd = o.where("o_orderkey % 2 <> 0").select("year", F.col("price").cast("string").alias("price"), F.col("o_orderkey").cast("string").alias("o_orderkey"))
    for load in (even, odd):
        tables.append(cleaning.align(load, STORED), path, ["year"])
    return s.read.schema(STORED).parquet(path)


@query("SNK2_truncate", "SELECT o_orderkey, round(o_totalprice, 6) AS price, year(CAST(o_orderdate AS DATE))::BIGINT AS year FROM orders WHERE o_totalprice > 100000")
def truncate(s, d):
    """A second load takes the place of the first, partitions that it lacks included."""
    path, o = folder(s, "truncated"), priced_orders(s, d)
    tables.truncate(o.withColumn("year", F.col("year") + 100), path, ["year"])
    tables.truncate(o.where("price > 100000"), path, ["year"])
    return s.read.parquet(path)


@query("TXT4_entry_dates", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE epoch(date_trunc('second', ts))::BIGINT END AS published FROM events")
def entry_dates(s, d):
    """Feed dates in four forms, the first that parses counts: with an offset, with a zone's name, without weekday and zone, broken but followed by a good one; and broken only."""
    k, ts = F.col("event_id") % 5, F.col("ts")
    plain = F.date_format(ts, "EEE, dd MMM yyyy HH:mm:ss")
    ahead = F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "EEE, dd MMM yyyy HH:mm:ss")
    first = F.when(k == 0, F.concat(ahead, F.lit(" +0200"))).when(k == 1, F.concat(plain, F.lit(" GMT"))).when(k == 2, F.date_format(ts, "d MMM yyyy HH:mm:ss")).otherwise("soon")
    rows = adapters.read(s, d, "events").select("event_id", first.alias("pubDate"), F.when(k == 3, F.concat(plain, F.lit(" +0000"))).alias("updated"), F.lit(None).cast("string").alias("created"))
    return rows.select("event_id", F.unix_seconds(tables.published(F.col)).alias("published"))


# ---- cleaned bars


@query("CLN1_clean_market", FAULTS[: FAULTS.index("\nf AS")].rstrip().rstrip(",") + """, c AS (SELECT symbol, date, k, open, high, low, close, volume FROM t WHERE symbol IS NOT NULL AND date IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY symbol, date ORDER BY (open IS NOT NULL)::INT + (high IS NOT NULL)::INT + (low IS NOT NULL)::INT + 2 * (close IS NOT NULL)::INT + (volume IS NOT NULL)::INT DESC, close NULLS FIRST, high NULLS FIRST, k) = 1)
SELECT symbol, date, k, (open IS NULL)::BIGINT AS open_was_missing, (high IS NULL)::BIGINT AS high_was_missing, round(greatest(open, high, low, close), 6) AS high, round(least(open, high, low, close), 6) AS low, round(close, 6) AS adjusted_close, volume::DOUBLE AS volume_filled
FROM c WHERE close IS NOT NULL AND (least(open, high, low, close) > 0 OR symbol = 'AF')""")
def clean_market(s, d):
    """Bars with every kind of fault; one symbol may be negative."""
    cleaned = cleaning.clean_market(faulty(s, d), ["AF"])
    return cleaned.select("symbol", "date", "k", "open_was_missing", "high_was_missing", "high", "low", "adjusted_close", F.col("volume_filled").cast("double").alias("volume_filled"))


# ---- models


@query("PRJ5_sentiment_of_model", "WITH " + STORY + " SELECT article_id::VARCHAR AS article_id, round(sentiment_score + CASE WHEN article_id % 3 = 0 THEN 1 ELSE 0 END, 6) + 0.0 AS sentiment_score FROM feel")
def sentiment_of_model(s, d):
    """Scores of two models, some of the first model's calculated twice: a row an article is left."""
    first = adapters.story_sentiment(s, d).withColumns({"sentiment_model": F.lit("m1"), "calculated_at": F.timestamp_seconds(F.lit(1_700_000_000))})
    again = first.where("article_id % 3 = 0").withColumns({"sentiment_score": F.col("sentiment_score") + 1, "calculated_at": F.timestamp_seconds(F.lit(1_700_000_060))})
    other = first.withColumns({"sentiment_model": F.lit("m2"), "sentiment_score": F.lit(9.0), "calculated_at": F.timestamp_seconds(F.lit(1_800_000_000))})
    return staging.sentiment(portfolio.stacked([first, again, other]), "m1").select("article_id", "sentiment_score")


@query("PRJ6_relevance_of_model", "SELECT vec_id::VARCHAR AS article_id, 'c' || label % 5 AS commodity_id, (label % 100) / 100.0::DOUBLE AS similarity_score FROM embeddings")
def relevance_of_model(s, d):
    of = adapters.vectors(s, d).select("article_id", F.concat(F.lit("c"), (F.col("label") % 5).cast("string")).alias("commodity_id"), ((F.col("label") % 100) / 100.0).alias("similarity_score"), F.lit("m1").alias("embedding_model"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("calculated_at"))
    early = of.withColumns({"similarity_score": F.lit(0.0), "calculated_at": F.lit(None).cast("timestamp")})
    return staging.relevance(portfolio.stacked([of, early, of.withColumn("embedding_model", F.lit("m2"))]), "m1").select("article_id", "commodity_id", "similarity_score")


def _terms(terms: tuple[str, ...]) -> str:
    return " + ".join(f"contains(said, '{t}')::INT" for t in terms)


@query("TXT9_default_lexicon", f"""WITH a AS (SELECT doc_id AS article_id, lower(coalesce(text, '') || ['', ' Prices fall', ' a strong gain', ' falls, then rises', ' BULLISH'][doc_id % 5 + 1]) AS said FROM documents), h AS (SELECT article_id, {_terms(tx.POSITIVE)} AS p, {_terms(tx.NEGATIVE)} AS n FROM a)
SELECT article_id, CASE WHEN p > n THEN 0.7 WHEN n > p THEN 0.1 ELSE 0.2 END::DOUBLE AS positive, CASE WHEN p <> n THEN 0.2 ELSE 0.6 END::DOUBLE AS neutral, CASE WHEN p > n THEN 0.1 WHEN n > p THEN 0.7 ELSE 0.2 END::DOUBLE AS negative FROM h""")
def default_lexicon(s, d):
    """The default terms on whole texts, to each of which a remark on the market is added: the tables' own prose has few of the terms."""
    remark = F.element_at(F.array(*(F.lit(x) for x in ("", " Prices fall", " a strong gain", " falls, then rises", " BULLISH"))), (F.col("doc_id") % 5 + 1).cast("int"))
    said = adapters.read(s, d, "documents").select(F.col("doc_id").alias("article_id"), F.concat(F.coalesce("text", F.lit("")), remark).alias("said"))
    return said.select("article_id", F.inline(F.array(tx.lexicon_sentiment(F.col("said")))))


# ---- stored benchmarks


@query("RUL10_stored_benchmarks", RECURSION + LEVELS.removeprefix(PANEL) + """,
w AS (SELECT date, names[i] AS symbol, u[i] * p[i] / list_sum(list_transform(list_zip(u, p), lambda z: z[1] * z[2])) AS actual_weight, CASE WHEN go THEN 1.0 / len(p) END AS target_weight, go FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM rec)),
ix AS (SELECT date, level, level / lag(level) OVER (ORDER BY date) - 1 AS r, level / max(level) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM rec),
ex AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) / 7 AS close FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1),
el AS (SELECT date, close, close / first_value(close) OVER (ORDER BY date) * 100 AS level FROM ex)
SELECT date, 'buy_hold_' || lower(symbol) AS benchmark_id, 'buy_and_hold' AS benchmark_type, symbol AS component_id, round(price, 6) AS close_price, round(lev.level, 4) AS benchmark_level,
  round(lev.level / lag(lev.level) OVER (PARTITION BY symbol ORDER BY date) - 1, 6) + 0.0 AS daily_return, NULL::DOUBLE AS drawdown, NULL::DOUBLE AS actual_weight, NULL::DOUBLE AS target_weight, NULL::BOOLEAN AS rebalance_executed FROM panel JOIN lev USING (symbol, date)
UNION ALL SELECT date, 'synthetic_commodity_index', 'synthetic_index', symbol, round(price, 6), round(ix.level, 4), round(r, 6) + 0.0, round(dd, 6) + 0.0, round(actual_weight, 6), round(target_weight, 6), go FROM panel JOIN ix USING (date) JOIN w USING (date, symbol)
UNION ALL SELECT date, 'global_commodities', 'global', 'GLOBAL', round(close, 6), round(level, 4), round(level / lag(level) OVER (ORDER BY date) - 1, 6) + 0.0, round(level / max(level) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 6) + 0.0, NULL, NULL, NULL FROM el""")
def stored_benchmarks(s, d):
    """All three kinds of the table: assets held, the index with its weights, and a benchmark from outside."""
    p = panel(s, d)
    days, weights = index.index_history(p, "year")
    levels = index.rebased(p)
    plain = portfolio.master(levels, p, days.select("date", "level"), p.select("symbol").distinct())
    rich = plain.join(days.select("date", F.col("daily_return").alias("index_return"), F.col("drawdown").alias("index_drawdown")), "date").join(weights, ["date", "symbol"])
    outside = adapters.read(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg((F.avg("o_totalprice") / 7).alias("close"))
    rows = portfolio.stacked([portfolio.stored_benchmarks(rich, "orders"), portfolio.external_benchmark(outside, "global_commodities", "GC", "Global commodities", "market", "orders")])
    return rows.select("date", "benchmark_id", "benchmark_type", "component_id", "close_price", "benchmark_level", "daily_return", "drawdown", "actual_weight", "target_weight", "rebalance_executed").withColumn("benchmark_level", F.round("benchmark_level", 4))


# ---- overview and scalars

SHOWN = "cumulative_return annualized_return annualized_volatility sharpe_ratio sortino_ratio max_drawdown calmar_ratio win_rate profit_factor outperformance exposure"


@query("JN7_overview_with_news", FULL + MARKET_CURVE + f""",
gm AS (SELECT strategy_name, symbol, max(benchmark_return) AS market FROM daily LEFT JOIN gc USING (date) GROUP BY ALL),
l AS (SELECT symbol, date, strategy_name, close, signal FROM sig QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY date DESC, strategy_name) = 1)
SELECT l.symbol, strategy_name, l.date AS latest_date, round(l.close, 6) AS latest_close, l.signal::BIGINT AS latest_signal, {", ".join(f"round(coalesce(feat.{c}, 0)::DOUBLE, 6) + 0.0 AS {c}" for c in metrics.OVERVIEW)},
  {out("", SHOWN, "trade_count")}, round(total_fees + total_slippage, 6) AS total_cost_rate, cumulative_return > coalesce(market, 0) AS beats_market
FROM l LEFT JOIN fullm USING (symbol, strategy_name) LEFT JOIN gm USING (symbol, strategy_name) LEFT JOIN feat ON feat.topic_id = l.symbol AND feat.date = l.date""")
def overview_with_news(s, d):
    curve = metrics.benchmark_curve(metrics.benchmark_daily(staged(s, d), portfolio.is_global()))
    rows = stored(strategies.compounded(strategies.with_costs(strategies.daily_returns(signals(s, d, metrics.OVERVIEW)))))  # for both sides
    shown = metrics.overview(rows, metrics.market_metrics(rows, curve))
    return shown.select("symbol", "strategy_name", "latest_date", "latest_close", "latest_signal", *(F.col(c).cast("double").alias(c) for c in metrics.OVERVIEW), *SHOWN.split(), "trade_count", "total_cost_rate", (F.col("outperformance_vs_global_benchmark") > 0).alias("beats_market"))


@query("AGG10_equity_scalars", BARS + """, r AS (SELECT symbol, date, close, coalesce(close / nullif(lag(close) OVER w, 0) - 1, 0) AS r, close / max(close) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS share FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY date)),
a AS (SELECT symbol, count(*) AS days, arg_max(close, date) / arg_min(close, date) AS g, avg(r) * 252 AS e, stddev_samp(r) * sqrt(252) AS v, stddev_samp(r) FILTER (r < 0) * sqrt(252) AS dn, min(share) - 1 AS max_drawdown, avg((r > 0)::INT) AS win_rate, sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0) AS profit_factor FROM r GROUP BY symbol),
b AS (SELECT *, pow(g, 252.0 / days) - 1 AS y FROM a)
SELECT symbol, days::BIGINT AS days, round(g - 1, 6) + 0.0 AS cumulative_return, round(y, 6) + 0.0 AS annualized_return, round(coalesce(v, 0), 6) AS annualized_volatility, round(coalesce(e / nullif(v, 0), 0), 6) + 0.0 AS sharpe_ratio, round(coalesce(e / nullif(dn, 0), 0), 6) + 0.0 AS sortino_ratio,
  round(max_drawdown, 6) + 0.0 AS max_drawdown, round(coalesce(y / nullif(abs(max_drawdown), 0), 0), 6) + 0.0 AS calmar_ratio, round(win_rate, 6) AS win_rate, round(profit_factor, 6) AS profit_factor FROM b""")
def equity_scalars(s, d):
    return metrics.equity_scalars(bars(s, d).select("symbol", "date", F.col("close").alias("equity")), ["symbol"])
