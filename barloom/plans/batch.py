"""Registered queries of batch jobs: feeds, market files, calendars, conversion, long series, whole indices, market-relative metrics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.functions import text as tx
from barloom.operators import calendars, cleaning, fx, index, metrics, news, portfolio, scans
from barloom.plans.market import BARS, DAILY, FULL, GAPPY, ORACLE_SQL, PANEL, bars, daily, gappy, panel, query
from barloom.plans.marts import BENCH, MARKET, staged
from barloom.sources import adapters, tables
from barloom.sources.scratch import checkpoint_dir

# ---- means over long series


@query("WIN9_macd_scan", ORACLE_SQL["WIN9_macd_kernel"])
def _(s, d):
    return scans.macd_kernel_scan(bars(s, d), chunk_rows=500)


@query("WIN10_ema_scan", ORACLE_SQL["WIN10_ema_recursive"])
def _(s, d):
    return scans.macd_recursive_scan(bars(s, d), chunk_rows=500)


# ---- a whole index

RECURSION = "WITH RECURSIVE " + PANEL.removeprefix("WITH ") + """, days AS (
  SELECT date, row_number() OVER (ORDER BY date) AS t, coalesce(date_trunc('year', date) <> lag(date_trunc('year', date)) OVER (ORDER BY date), true) AS go FROM (SELECT DISTINCT date FROM panel)),
ps AS (SELECT t, go, date, list(price ORDER BY symbol) AS p, list(symbol ORDER BY symbol) AS names FROM panel JOIN days USING (date) GROUP BY ALL),
rec AS (
  SELECT t, date, go, p, names, list_transform(p, lambda x: 100.0 / len(p) / x) AS u, 100.0::DOUBLE AS gross, 100.0::DOUBLE AS level, 0.0::DOUBLE AS turnover FROM ps WHERE t = 1
  UNION ALL
  SELECT t, date, go, p, names, CASE WHEN go THEN list_transform(p, lambda x: net / len(p) / x) ELSE u END, gross, CASE WHEN go THEN net ELSE gross END, CASE WHEN go THEN turn ELSE 0.0 END
  FROM (SELECT *, gross * (1 - turn * 10 / 1e4) AS net FROM (
    SELECT *, list_sum(list_transform(list_zip(u, p), lambda z: abs(1.0 / len(p) - z[1] * z[2] / gross))) / 2 AS turn FROM (
      SELECT ps.t, ps.date, ps.go, ps.p, ps.names, rec.u, list_sum(list_transform(list_zip(rec.u, ps.p), lambda z: z[1] * z[2])) AS gross FROM rec JOIN ps ON ps.t = rec.t + 1))))"""


@query("WIN34_index_days", RECURSION + """
SELECT date, round(gross, 6) AS gross_level, round(level, 6) AS level, go AS rebalance_requested, go AS rebalance_executed, false AS rebalance_skipped, round(turnover, 6) AS turnover,
  round(CASE WHEN go THEN gross - level ELSE 0 END, 6) + 0.0 AS transaction_cost, round(level / lag(level) OVER (ORDER BY date) - 1, 6) + 0.0 AS daily_return,
  round(max(level) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING), 6) AS running_peak, round(level / max(level) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 6) + 0.0 AS drawdown
FROM rec""")
def _(s, d):
    return index.index_history(panel(s, d), "year")[0]


@query("WIN34_index_weights", RECURSION + """
SELECT date, names[i] AS symbol, round(u[i] * p[i] / list_sum(list_transform(list_zip(u, p), lambda z: z[1] * z[2])), 6) AS actual_weight, CASE WHEN go THEN round(1.0 / len(p), 6) END AS target_weight, go AS rebalance_executed
FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM rec)""")
def _(s, d):
    return index.index_history(panel(s, d), "year")[1]


@query("JN18_master_with_weights", RECURSION + """,
w AS (SELECT date, names[i] AS symbol, u[i] * p[i] / list_sum(list_transform(list_zip(u, p), lambda z: z[1] * z[2])) AS weight FROM (SELECT *, unnest(range(1, len(p) + 1)) AS i FROM rec))
SELECT symbol, date, round(price, 6) AS price, round(weight, 6) AS actual_weight, round(r.level, 4) AS index_level FROM panel JOIN w USING (date, symbol) JOIN rec r USING (date)""")
def _(s, d):
    p = panel(s, d)
    days, weights = index.index_history(p, "year")
    levels = index.rebased(p)
    dim = p.select("symbol").distinct().withColumn("width", F.length("symbol"))
    m = portfolio.master(levels, p, days.select("date", "level"), dim)
    return m.join(weights.select("date", "symbol", "actual_weight"), ["date", "symbol"], "left").select("symbol", "date", "price", "actual_weight", F.round("index_level", 4).alias("index_level"))


@query("WIN36_local_portfolio", GAPPY + """, w AS (SELECT * FROM gap QUALIFY count(price) OVER (PARTITION BY date) = count(*) OVER (PARTITION BY date)),
r AS (SELECT date, avg(r) AS daily_return FROM (SELECT date, coalesce(price / lag(price) OVER (PARTITION BY symbol ORDER BY date) - 1, 0) AS r FROM w) GROUP BY date),
l AS (SELECT *, 100 * exp(sum(ln(1 + daily_return)) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) AS level FROM r)
SELECT date, round(daily_return, 6) + 0.0 AS daily_return, round(log10(level), 6) + 0.0 AS log_level, round(level / max(level) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) - 1, 6) + 0.0 AS drawdown FROM l""")
def _(s, d):
    return index.local_portfolio(gappy(s, d)).select("date", "daily_return", F.log10("level").alias("log_level"), "drawdown")


# ---- metrics beside the market

MARKET_CURVE = BENCH.replace("WITH raw", ", raw") + f""", gb AS (SELECT date, avg(daily_return) AS daily_return FROM stg WHERE {MARKET} GROUP BY date),
gc AS (SELECT date, exp(sum(ln(greatest(1 + daily_return, 1e-6))) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS benchmark_return FROM gb)"""


@query("AGG3_metrics_beside_market", FULL + MARKET_CURVE + """,
gm AS (SELECT strategy_name, symbol, max(benchmark_return) AS market FROM daily LEFT JOIN gc USING (date) GROUP BY ALL)
SELECT strategy_name, symbol, round(log10(1 + market), 4) + 0.0 AS log_market, round(total_fees + total_slippage, 6) AS total_cost_rate, round(coalesce(average_position_days, 0), 6) AS average_position_days,
  round(outperformance, 6) + 0.0 AS outperformance, cumulative_return > coalesce(market, 0) AS beats_market FROM fullm JOIN gm USING (strategy_name, symbol)""")
def _(s, d):
    curve = metrics.benchmark_curve(metrics.benchmark_daily(staged(s, d), portfolio.is_global()))
    m = metrics.market_metrics(daily(s, d), curve)
    market = F.col("global_benchmark_cumulative_return")
    return m.select("strategy_name", "symbol", F.round(F.log10(1 + market), 4).alias("log_market"), "total_cost_rate", "average_position_days", "outperformance", (F.col("outperformance_vs_global_benchmark") > 0).alias("beats_market"))


@query("AGG5_market_daily", BENCH + f" SELECT date, round(avg(daily_return), 6) + 0.0 AS daily_return FROM stg WHERE {MARKET} GROUP BY date")
def _(s, d):
    return metrics.benchmark_daily(staged(s, d), portfolio.is_global())


PERIOD_ROWS = [(1, "calibration", "tune", True, "1995-01-01", "1998-12-31"), (2, "validation", "choose", True, "1998-07-01", "1999-12-31"), (3, "test", "report", False, "2000-01-01", None)]
PERIOD_SQL = "(VALUES " + ", ".join(f"({i}, '{n}', '{p}', {str(o).lower()}, DATE '{a}', {f'DATE {z!r}' if z else 'NULL'})" for i, n, p, o, a, z in PERIOD_ROWS) + ") AS v(position, period, purpose, optimisable, first, last)"


@query("RUL8_periods_with_purpose", BARS + f""", p AS (SELECT * FROM {PERIOD_SQL}), m AS (SELECT symbol, b.date, arg_max(p.period, position) AS period, arg_max(purpose, position) AS purpose, arg_max(optimisable, position) AS optimisable
  FROM bars b LEFT JOIN p ON b.date >= p.first AND (p.last IS NULL OR b.date <= p.last) GROUP BY ALL)
SELECT symbol, date, coalesce(period, 'out_of_scope') AS period, purpose, coalesce(optimisable, false) AS optimisable FROM m""")
def _(s, d):
    periods = s.createDataFrame(PERIOD_ROWS, "position int, period string, purpose string, optimisable boolean, first string, last string").withColumns({c: F.col(c).cast("date") for c in ("first", "last")})
    return metrics.with_periods(bars(s, d).select("symbol", "date"), periods)


# ---- conversion

OF = ("EUR", "USD", "GBP", "JPY", None)
FX = BARS + """, pr AS (SELECT symbol, CASE symbol WHEN '1-URGENT' THEN 'EUR' WHEN '2-HIGH' THEN 'USD' WHEN '3-MEDIUM' THEN 'GBP' WHEN '4-NOT SPECIFIED' THEN 'JPY' END AS currency, date, close / 7.3::DOUBLE AS price FROM bars),
q AS (SELECT CASE l_suppkey % 3 WHEN 0 THEN 'USD' ELSE 'EUR' END AS base, CASE l_suppkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'GBP' ELSE 'USD' END AS quote, CAST(l_shipdate AS DATE) AS date, avg(l_discount) + 0.9 AS rate FROM lineitem WHERE l_shipdate < DATE '1998-06-01' GROUP BY ALL),
r AS (SELECT 'USD' AS currency, date, rate FROM q WHERE base = 'USD' UNION ALL SELECT 'GBP', date, 1 / rate FROM q WHERE quote = 'GBP')"""


def quotes(s, d):
    k = F.col("l_suppkey") % 3
    li = adapters.read(s, d, "lineitem").where("l_shipdate < '1998-06-01'")
    base, quote = F.when(k == 0, "USD").otherwise("EUR"), F.when(k == 0, "EUR").when(k == 1, "GBP").otherwise("USD")
    return li.groupBy(base.alias("base"), quote.alias("quote"), F.to_date("l_shipdate").alias("date")).agg((F.avg("l_discount") + 0.9).alias("rate"))


def priced(s, d):
    names = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED")
    currency = F.coalesce(*(F.when(F.col("symbol") == n, c) for n, c in zip(names, OF)))
    return bars(s, d).select("symbol", currency.alias("currency"), "date", (F.col("close") / 7.3).alias("price"))


@query("JN14_fx_pairs", FX + """, cal AS (SELECT currency, date, max(rate) AS rate FROM (SELECT currency, date, NULL::DOUBLE AS rate FROM pr WHERE currency IN ('USD', 'GBP') UNION ALL SELECT * FROM r) GROUP BY ALL),
num AS (SELECT *, row_number() OVER (PARTITION BY currency ORDER BY date) AS pos FROM cal),
car AS (SELECT currency, date, CASE WHEN pos - last(CASE WHEN rate IS NOT NULL THEN pos END IGNORE NULLS) OVER w <= 5 THEN last(rate IGNORE NULLS) OVER w END AS rate FROM num WINDOW w AS (PARTITION BY currency ORDER BY date ROWS UNBOUNDED PRECEDING))
SELECT symbol, currency, date, round(price, 6) AS price, 1.0::DOUBLE AS rate, round(price, 6) AS converted FROM pr WHERE currency = 'EUR'
UNION ALL SELECT symbol, currency, date, round(price, 6), round(rate, 6), round(price * rate, 6) FROM pr JOIN car USING (currency, date)""")
def _(s, d):
    return fx.converted(priced(s, d), quotes(s, d), "EUR")[0]


@query("JN14_fx_missing", FX + " SELECT DISTINCT currency, 'no rate from ' || coalesce(currency, 'an unknown currency') || ' to EUR' AS error FROM pr WHERE currency IS NULL OR currency NOT IN ('EUR', 'USD', 'GBP')")
def _(s, d):
    return fx.converted(priced(s, d), quotes(s, d), "EUR")[1]


# ---- files and feeds

UNIVERSE = ("3-MEDIUM", "1-URGENT", "5-LOW")


def file_of_orders(s, d) -> str:
    """A CSV of the orders' prices, in the shared checkpoint folder."""
    o = adapters.read(s, d, "orders")
    path = f"{checkpoint_dir(s)}/orders-{uuid.uuid4().hex}"
    day = F.when(F.col("o_orderkey") % 50 == 0, "no date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    tables.write_csv(o.select(F.col("o_orderpriority").alias("symbol"), day.alias("date"), F.col("o_totalprice").alias("close"), F.format_string("%012d", "o_orderkey").alias("ingested_at")), path)
    return path


LONG = "SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS symbol, arg_max(o_totalprice, o_orderkey) AS price FROM orders WHERE o_orderkey % 50 <> 0 AND o_orderpriority IN ('3-MEDIUM', '1-URGENT', '5-LOW') GROUP BY ALL"


@query("SRC2_market_panel", f"""WITH l AS ({LONG}) SELECT date, {", ".join(f'round(max(price) FILTER (symbol = {n!r}), 6) AS "{n}"' for n in UNIVERSE)} FROM l GROUP BY date""")
def _(s, d):
    return tables.scan_market_csv(s, file_of_orders(s, d), UNIVERSE)


@query("SRC4_latest_snapshot", "SELECT o_orderkey, o_totalprice::DOUBLE AS o_totalprice FROM orders WHERE year(CAST(o_orderdate AS DATE)) = 1997")
def _(s, d):
    """A snapshot a year, the newest without rows."""
    o, stem = adapters.read(s, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), F.year("o_orderdate").alias("year")), f"{checkpoint_dir(s)}/snapshots-{uuid.uuid4().hex}"
    for year in (1995, 1997, 2005):
        tables.write_csv(o.where(F.col("year") == year).drop("year"), f"{stem}/orders_{year}1231.csv")
    return tables.latest_snapshot(s, f"{stem}/orders_*.csv", o.drop("year").schema)


@query("SRC5_reshape_wide", f"""WITH l AS ({LONG}) SELECT g.date, g.symbol, round(l.price, 6) AS close FROM (SELECT DISTINCT l.date, u.symbol FROM l, l AS u) g LEFT JOIN l ON l.date = g.date AND l.symbol = g.symbol""")
def _(s, d):
    wide = tables.scan_market_csv(s, file_of_orders(s, d), UNIVERSE)
    return tables.wide_to_long(wide.withColumnsRenamed({n: f"Close|{n}" for n in UNIVERSE}), ["date"])


@query("CLN8_clean_news", """WITH r AS (SELECT doc_id // 2 AS article_id, trim(string_split(text, chr(10))[1]) AS title, md5(text) AS content_hash, doc_id FROM documents),
a AS (SELECT * FROM r WHERE title <> '' AND article_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY doc_id DESC, content_hash DESC) = 1)
SELECT article_id, content_hash, title, doc_id FROM a QUALIFY row_number() OVER (PARTITION BY content_hash ORDER BY doc_id DESC, article_id DESC) = 1""")
def _(s, d):
    raw = adapters.read(s, d, "documents").select(F.expr("doc_id div 2").alias("article_id"), F.split("text", "\n")[0].alias("title"), F.md5(F.encode("text", "UTF-8")).alias("content_hash"), "doc_id")
    return cleaning.clean_news(raw, F.col("doc_id"))


@query("DQ11_source_freshness", "SELECT max(CAST(o_orderdate AS DATE)) AS last_stamp, CASE WHEN DATE '1998-08-06' - max(CAST(o_orderdate AS DATE)) > 7 THEN 'error' WHEN DATE '1998-08-06' - max(CAST(o_orderdate AS DATE)) > 2 THEN 'warn' ELSE 'pass' END AS status FROM orders")
def _(s, d):
    stamped = adapters.read(s, d, "orders").select(F.to_date("o_orderdate").alias("loaded"))
    return cleaning.freshness_status(stamped, F.lit("1998-08-06").cast("date"), "loaded")


@query("SET4_pivot_and_back", f"WITH l AS ({LONG}) SELECT date, symbol, round(price, 6) AS price FROM l")
def _(s, d):
    o = adapters.read(s, d, "orders").where("o_orderkey % 50 <> 0").select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").cast("double").alias("price"), "o_orderkey")
    wide = tables.price_panel(o, UNIVERSE, "symbol", "price", "o_orderkey")
    return wide.unpivot("date", list(UNIVERSE), "symbol", "price").where("price IS NOT NULL")


@query("SRC6_feed_articles", """WITH i AS (SELECT page_id, url, 'feed' || (page_id % 4) AS feed_id, TIMESTAMP '2024-01-01 00:00:00' + to_hours((page_id % 600)::INT) AS seen FROM pages WHERE page_id % 7 <> 0 AND page_id % 4 < 3),
c AS (SELECT *, 'src-' || feed_id AS source_id, 'Page ' || page_id || ' & more' AS title, 'Body of ' || page_id || ' moved.' AS clean_text FROM i)
SELECT feed_id, source_id, page_id AS priority, title, clean_text, strftime(seen, '%Y-%m-%d %H:%M:%S') AS published, sha256(lower(title) || '|' || lower(clean_text)) AS content_hash FROM c""")
def _(s, d):
    return tables.feed_articles(*feed(s, d))[0].select("feed_id", "source_id", F.regexp_extract("title", r"(\d+)", 1).cast("long").alias("priority"), "title", "clean_text", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"), "content_hash")


@query("SRC6_feed_errors", """SELECT 'feed' || (page_id % 4) AS feed_id, CASE WHEN page_id % 7 = 0 THEN 'malformed item' ELSE 'unknown feed' END AS error, count(*)::BIGINT AS n FROM pages WHERE page_id % 7 = 0 OR page_id % 4 = 3 GROUP BY ALL""")
def _(s, d):
    return tables.feed_articles(*feed(s, d))[1].groupBy("feed_id", "error").agg(F.count("*").alias("n"))


def feed(s, d):
    """A stored item for each page, every seventh one broken, of four feeds of which three are known."""
    i = F.col("page_id")
    at = F.timestamp_seconds(F.lit(1704067200) + (i % 600) * 3600)
    said = F.concat(F.lit("<item><title>Page "), i.cast("string"), F.lit(" &amp;amp; more</title><link>https://Example.com/a?utm_source=x&amp;id="), i.cast("string"), F.lit("</link><pubDate>"), F.date_format(at, "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000</pubDate><description>&lt;p&gt;Body of &lt;b&gt;"), i.cast("string"), F.lit("&lt;/b&gt; moved.&lt;/p&gt;</description>"), F.when(i % 7 == 0, "<broken>").otherwise("</item>"))
    feeds = s.createDataFrame([(f"feed{k}", f"src-feed{k}", "Source", "Feed", "metals", "en", k, "high") for k in range(3)], "feed_id string, source_id string, source string, feed_name string, category string, language string, priority int, quality string")
    return adapters.read(s, d, "pages").select(F.concat(F.lit("feed"), (i % 4).cast("string")).alias("feed_id"), said.alias("item")), feeds


@query("TXT1_clean_pages")
def _(s, d):
    return adapters.read(s, d, "pages").select("page_id", tx.clean_html(F.col("html")).alias("clean_text"))


@query("TXT7_token_lists", "SELECT doc_id AS article_id, sha256(array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[a-zA-Z][a-zA-Z0-9_+-]{2,}'), lambda x: lower(x)))), ' ')) AS tokens_hash FROM documents")
def _(s, d):
    return adapters.articles(s, d).select("article_id", F.sha2(F.array_join(F.array_sort(tx.tokens(F.coalesce("clean_text", F.lit("")))), " "), 256).alias("tokens_hash"))


# ---- quality

FAULTS = """WITH raw AS (SELECT l_returnflag || l_linestatus AS symbol, CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS date, l_orderkey * 10 + l_linenumber AS k,
  CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_extendedprice / 100 END AS open, l_extendedprice / 100 + (l_partkey % 5) - 1 AS high, l_extendedprice / 100 - 1 AS low,
  CASE WHEN l_partkey % 13 = 0 THEN NULL WHEN l_partkey % 17 = 0 THEN -1 ELSE l_extendedprice / 100 END AS close, l_quantity AS volume, l_partkey % 19 = 0 AS blank FROM lineitem),
t AS (SELECT symbol, date, k, volume, CASE WHEN blank THEN NULL ELSE open END AS open, CASE WHEN blank THEN NULL ELSE high END AS high, CASE WHEN blank THEN NULL ELSE low END AS low, CASE WHEN blank THEN NULL ELSE close END AS close FROM raw),
f AS (SELECT *, CASE WHEN date IS NULL THEN 'no_date' WHEN row_number() OVER (PARTITION BY symbol, date ORDER BY k DESC, close NULLS FIRST, high NULLS FIRST, k, low NULLS FIRST, open NULLS FIRST, volume) > 1 THEN 'duplicate' WHEN coalesce(open, high, low, close) IS NULL THEN 'empty' WHEN close IS NULL THEN 'missing_close' WHEN least(open, high, low, close) <= 0 THEN 'non_positive' ELSE 'kept' END AS fate FROM t)"""


def faulty(s, d):
    """Line items as raw bars with every kind of fault."""
    p, price, blank = F.col("l_partkey"), F.col("l_extendedprice") / 100, F.col("l_partkey") % 19 == 0
    unless = lambda c: F.when(~blank, c)
    close = F.when(p % 13 == 0, None).when(p % 17 == 0, -1.0).otherwise(price)
    return adapters.read(s, d, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.when(F.col("l_orderkey") % 97 != 0, F.to_date("l_shipdate")).alias("date"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), unless(F.when(p % 11 != 0, price)).alias("open"),
        unless(price + p % 5 - 1).alias("high"), unless(price - 1).alias("low"), unless(close).alias("close"), unless(close).alias("adjusted_close"), F.col("l_quantity").alias("volume"),
    )


@query("CLN3_quality_counters", FAULTS + """
SELECT symbol, count(*)::BIGINT AS rows_downloaded, count(*) FILTER (fate = 'kept')::BIGINT AS rows_after_cleaning, count(*) FILTER (fate = 'duplicate')::BIGINT AS duplicate_dates_removed, count(*) FILTER (fate = 'empty')::BIGINT AS empty_rows_dropped,
  count(*) FILTER (fate = 'non_positive')::BIGINT AS non_positive_price_rows_dropped, count(*) FILTER (fate = 'kept' AND (high < greatest(open, high, low, close) OR low > least(open, high, low, close)))::BIGINT AS ohlc_inconsistent_rows_fixed,
  """ + ", ".join(f"count(*) FILTER (fate IN ('missing_close', 'non_positive', 'kept') AND {c} IS NULL)::BIGINT AS {c if n is None else n}_missing" for c, n in (("open", None), ("high", None), ("low", None), ("close", None), ("close", "adjusted_close"), ("volume", None))) + """,
  min(date) FILTER (fate = 'kept') AS first_date, max(date) FILTER (fate = 'kept') AS last_date FROM f GROUP BY symbol""")
def _(s, d):
    return cleaning.quality_counters(cleaning.judged(faulty(s, d), F.col("k")))


@query("CLN4_missing_report", FAULTS + ", " + "m AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS b, count(*) FILTER ({c} IS NULL AND fate = 'kept') AS a, count(*) AS n FROM f" for c in ("open", "close", "volume")) + ') SELECT "column", b::BIGINT AS missing_before, a::BIGINT AS missing_after, (b - a)::BIGINT AS treated, round(100.0 * b / n, 6) AS missing_rate FROM m')
def _(s, d):
    rows = cleaning.judged(faulty(s, d), F.col("k"))
    return cleaning.missing_report(rows, cleaning.mended(rows), ["open", "close", "volume"])


@query("CLN10_missing_symbols", "SELECT c_name AS symbol FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice >= 150000)")
def _(s, d):
    expected = adapters.read(s, d, "customer").select(F.col("c_name").alias("symbol"), "c_custkey")
    traded = adapters.read(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_totalprice") >= 150000, F.col("o_totalprice")).alias("close")).join(expected, "c_custkey").select("symbol", "close")
    return cleaning.missing_symbols(expected.select("symbol"), traded)


# ---- calendars

SPAN = "(SELECT unnest(generate_series(DATE '1995-12-28', DATE '1998-02-03', INTERVAL 1 DAY))::DATE AS date)"


@query("DAT1_calendars", f"""SELECT kind, count(DISTINCT o.o_orderkey)::BIGINT AS orders, count(DISTINCT c.date)::BIGINT AS days FROM (
  SELECT 'business' AS kind, date FROM {SPAN} WHERE isodow(date) < 6 UNION ALL SELECT 'month_end', date FROM {SPAN} WHERE last_day(date) = date UNION ALL SELECT 'quarter_end', date FROM {SPAN} WHERE last_day(date) = date AND month(date) % 3 = 0
  UNION ALL SELECT 'year_start', date FROM {SPAN} WHERE dayofyear(date) = 1) c LEFT JOIN orders o ON CAST(o.o_orderdate AS DATE) = c.date GROUP BY kind""")
def _(s, d):
    kinds = ("business", "month_end", "quarter_end", "year_start")
    days = portfolio.stacked([calendars.calendar(s, "1995-12-28", "1998-02-03", k).withColumn("kind", F.lit(k)) for k in kinds])
    o = adapters.read(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    return days.join(o, "date", "left").groupBy("kind").agg(F.count_distinct("o_orderkey").alias("orders"), F.count_distinct("date").alias("days"))


@query("JN11_dense_grid_of_span", """WITH f AS (SELECT nullif(lang, 'de') AS lang, DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS date, count(*) AS articles FROM documents GROUP BY ALL), k AS (SELECT DISTINCT lang FROM f),
g AS (SELECT * FROM k CROSS JOIN (SELECT unnest(generate_series(DATE '2023-12-20', DATE '2024-01-31', INTERVAL 1 DAY))::DATE AS date))
SELECT g.lang, g.date, coalesce(articles, 0)::BIGINT AS articles FROM g LEFT JOIN f ON f.date = g.date AND f.lang IS NOT DISTINCT FROM g.lang""")
def _(s, d):
    counted = adapters.articles(s, d).groupBy(F.nullif(F.col("language"), F.lit("de")).alias("lang"), F.col("published").alias("date")).agg(F.count("*").alias("articles"))
    return news.dense(counted, ["lang"], ["articles"], "2023-12-20", "2024-01-31").select("lang", "date", F.col("articles").cast("long").alias("articles"))


@query("JN12_pending_for_model", "SELECT DISTINCT doc_id AS article_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label % 3 = 1)")
def _(s, d):
    done = adapters.vectors(s, d).select("article_id", F.concat(F.lit("m"), (F.col("label") % 3).cast("string")).alias("embedding_model"))
    return news.pending(adapters.articles(s, d), done, "m1")
