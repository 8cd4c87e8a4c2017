"""Hand-checked values and invariants of the market operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.functions import text as tx
from barloom.functions.nullsafe import divide, finite, strict_greatest
from barloom.operators import cleaning, index, indicators, ledger, metrics, news, portfolio, staging, strategies
from barloom.operators.windows import asof, fill_forward, interpolate
from barloom.plans import market
from barloom.sources import tables

DAY = dt.date(2024, 1, 1)


def series(spark, values, symbol="A", name="close"):
    return spark.createDataFrame([(symbol, DAY + dt.timedelta(i), v) for i, v in enumerate(values)], f"symbol string, date date, {name} double")


def test_null_rules(spark):
    r = spark.sql("SELECT CAST(NULL AS double) AS n, 0.0D AS z, CAST('NaN' AS double) AS q, 2.0D AS x").select(strict_greatest(F.col("n"), F.col("x")).alias("a"), divide(F.col("x"), F.col("z")).alias("b"), finite(F.col("q")).alias("c"), finite(F.col("x")).alias("d")).first()
    assert (r.a, r.b, r.c, r.d) == (None, None, None, 2.0)


def test_breakout_latch(spark):
    def signal(close, entry, leave):
        b = strategies.breakout_state(indicators.previous_extremes(series(spark, close), entry, leave))
        return [(r.breakout, r.breakout_reason) for r in b.orderBy("date").collect()]

    assert signal([100.0, 110.0, 108.0], 2, 2) == [(0, "flat_no_breakout"), (1, "entry_breaks_previous_high"), (1, "hold_after_breakout")]
    assert signal([100.0, 105.0, 104.0, 99.0], 1, 2)[3] == (0, "exit_breaks_previous_low")


def test_indicators_do_not_look_ahead(spark):
    values = [100 + (i * 37 % 23) - (i * 11 % 17) for i in range(60)]
    bars = lambda n: series(spark, [float(v) for v in values[:n]]).withColumns({"open": F.col("close"), "high": F.col("close") + 1, "low": F.col("close") - 1, "volume": F.lit(1.0)})
    whole, part = (indicators.technical(bars(n)).orderBy("date").collect() for n in (60, 40))
    assert whole[:40] == part
    assert all(0 <= r.rsi_14 <= 100 for r in whole if r.rsi_14 is not None)


def test_first_trade_is_on_the_second_day(spark):
    s = series(spark, [100.0, 101.0, 99.0]).withColumns({"strategy_name": F.lit("s"), "signal": F.lit(1)})
    rows = ledger.ledger(s).orderBy("date").collect()
    assert rows[0].position == 0 and rows[0].action is None and rows[1].action == "BUY" and rows[1].cash == pytest.approx(0, abs=1e-6)
    assert rows[1].equity < 100_000 and len(rows) == 3


def test_caps(spark):
    w = lambda ws: spark.createDataFrame([(DAY, f"s{i}", x) for i, x in enumerate(ws)], "date date, symbol string, weight double")
    got = [r.weight for r in index.capped(w([0.6, 0.25, 0.15]), 0.4).collect()]
    assert sum(got) == pytest.approx(1) and max(got) <= 0.4 + 1e-12
    with pytest.raises(Exception, match="infeasible"):
        index.capped(w([0.25] * 4), 0.2).collect()


def test_fills(spark):
    s = series(spark, [1.0, None, None, None, 5.0, None], name="price")
    assert [r.price for r in fill_forward(s, "price", ["symbol"], 2).orderBy("date").collect()] == [1, 1, 1, None, 5, 5]
    assert [r.price for r in interpolate(s, "price", ["symbol"], 2).orderBy("date").collect()] == [1, 2, 3, None, 5, None]
    rate = spark.createDataFrame([("A", DAY, 0.9)], "symbol string, date date, rate double")
    assert [r.rate for r in asof(series(spark, [1.0] * 8), rate, ["symbol"], "rate", 5).orderBy("date").collect()] == [0.9] * 6 + [None] * 2


def test_cash_reserve(spark):
    p = spark.createDataFrame([("p", DAY, None), ("p", DAY + dt.timedelta(1), 0.10), ("p", DAY + dt.timedelta(2), -0.05)], "portfolio string, date date, daily_return double")
    r = index.cash_reserve(p, 0.5).orderBy("date").collect()[1]
    assert r.daily_return == pytest.approx(0.05) and r.level == pytest.approx(105)


def test_periods(spark):
    p = (("calibration", "2020-01-01", "2023-12-31"), ("validation", "2024-01-01", "2024-12-31"), ("test", "2025-01-01", "2025-12-31"))
    d = spark.createDataFrame([(x,) for x in ("2020-01-02", "2024-06-03", "2025-01-02", "2019-12-31")], "d string").select(metrics.assign_period(F.to_date("d"), p).alias("p"))
    assert [r.p for r in d.collect()] == ["calibration", "validation", "test", "out_of_scope"]


def test_text(spark):
    row = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert row(tx.clean_html(F.lit("<p>Gold <b>prices</b>&nbsp;rise</p>"))) == "Gold prices rise"
    assert row(tx.clean_html(F.lit("S&P futures commentary"))) == "S&P futures commentary"
    assert row(tx.clean_html(F.lit("caf&eacute; &#x27;ok&#39; &amp;lt; &lt; &nope;"))) == "café 'ok' &lt; < &nope;"
    assert row(tx.canonical_url(F.lit("HTTPS://Example.com/news?id=1&utm_source=rss&gclid=abc#section"))) == "https://example.com/news?id=1"
    assert row(tx.source_weight(F.lit("very_high"), F.lit(1))) == pytest.approx(1.44)
    assert row(tx.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b")))) == 0.5


def test_clean_market(spark):
    rows = [("A", "2024-01-01", 10.0, 9.0, 11.0, 10.0, None, None), ("A", "2024-01-01", 10.0, None, None, None, None, None), ("B", "2024-01-01", 1.0, 1.0, 1.0, -1.0, None, None), ("C", "x", 1.0, 1.0, 1.0, 1.0, None, None)]
    df = spark.createDataFrame(rows, "symbol string, date string, open double, high double, low double, close double, adjusted_close double, volume double")
    got = cleaning.clean_market(df).collect()
    assert len(got) == 1 and (got[0].high, got[0].low, got[0].adjusted_close, got[0].volume_filled) == (11.0, 9.0, 10.0, 0.0)
    assert cleaning.clean_market(df, ["B"]).count() == 2


def test_upsert_with_null_keys(spark):
    t = spark.createDataFrame([(1, None, "old"), (2, "x", "keep")], "k long, c string, v string")
    s = spark.createDataFrame([(1, None, "new")], "k long, c string, v string")
    assert sorted(r.v for r in cleaning.upsert(t, s, ["k", "c"]).collect()) == ["keep", "new"]


def test_signal_chain_shuffles_once_on_symbol(spark):
    plan = strategies.breakout_state(market.tech(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 2  # bars by (symbol, date), then all windows by symbol
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_metrics_costs_and_runs_are_one_aggregation(spark):
    days = market.daily(spark, "/root/testdata/sf0.001")
    for plan in (metrics.full_metrics(days), market.period_metrics(spark, "/root/testdata/sf0.001")):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert text.count("Exchange hashpartitioning(symbol") == 2 and text.count("FileScan parquet") == days._jdf.queryExecution().executedPlan().toString().count("FileScan parquet")
    keys = ["strategy_name", "symbol"]
    runs = strategies.position_runs(days).groupBy(*keys).agg(F.avg("days").alias("length"))
    costs = strategies.trades(days).groupBy(*keys).agg(F.count("*").alias("n"), F.sum("fee_cost").alias("fees"))
    found = metrics.full_metrics(days).join(runs, keys, "left").join(costs, keys, "left").collect()
    assert len(found) == 25 and any(r.length is not None for r in found)
    for r in found:
        assert r.average_position_days == (None if r.length is None else pytest.approx(r.length))
        assert r.trade_count == (r.n or 0) and r.total_fees == pytest.approx(r.fees or 0.0)


def test_news_is_joined_before_the_shuffle_on_symbol(spark):
    plan = market.daily(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 2 and "CartesianProduct" not in plan


def test_source_weights(spark):
    cases = [("very_high", 1, 1.44), ("medium", 1, 0.84), ("medium_high", 1, 1.02), ("high", None, 0.75), ("high", 0, 0.75), ("HIGH", 1, 1.2), (None, 9, 0.375)]
    df = spark.createDataFrame(cases, "q string, p int, want double")
    assert all(r.got == pytest.approx(r.want) for r in df.select("want", tx.source_weight(F.col("q"), F.col("p")).alias("got")).collect())


def test_normalised_scores(spark):
    one = "array<struct<label:string,score:double>>"
    df = spark.createDataFrame([([("positive", 0.8)],), ([("negative", 1.0)],), ([("Positive", 0.3), ("neutral", 0.6), ("negative", 0.1)],), ([("neutral", 0.5)],), ([],)], f"s {one}")
    got = [tuple(round(x, 6) for x in r.x) for r in df.select(tx.normalised_scores(F.col("s")).alias("x")).collect()]
    assert got == [(0.8, 0.2, 0.0), (0.0, 0.0, 1.0), (0.3, 0.6, 0.1), (0.25, 0.5, 0.25), (0.0, 0.0, 0.0)]


def test_lexicon(spark):
    df = spark.createDataFrame([("Gold RISES, stronger",), ("prices fall",), ("rise and fall",), (None,)], "t string").select(tx.lexicon_sentiment(F.col("t")).alias("x"))
    assert [tuple(r.x) for r in df.collect()] == [(0.7, 0.2, 0.1), (0.1, 0.2, 0.7), (0.2, 0.6, 0.2), (0.2, 0.6, 0.2)]


def test_filter_adds_value_only_if_nothing_is_worse(spark):
    rows = [("test", "GC=F", "a", 0.10, 0.8, -0.20), ("test", "GC=F", "b", 0.12, 0.9, -0.15), ("test", "SI=F", "a", 0.10, 0.8, -0.20), ("test", "SI=F", "b", 0.12, 0.7, -0.15), ("test", "X", "b", 1.0, 1.0, 0.0)]
    got = metrics.filter_contribution(spark.createDataFrame(rows, "period string, symbol string, strategy_name string, cumulative_return double, sharpe_ratio double, max_drawdown double"), "b", "a", ["period", "symbol"])
    assert {r.symbol: (round(r.return_delta, 6), r.adds_value) for r in got.collect()} == {"GC=F": (0.02, True), "SI=F": (0.02, False)}


def test_news_rule_thresholds(spark):
    rows = [(0.0, 0.0, 0.0, 50.0, 1), (None, None, None, 50.0, 1), (-0.16, 0.0, 0.0, 50.0, 0), (-0.15, 0.0, 0.0, 50.0, 1), (0.0, 0.75, 0.0, 50.0, 0), (0.0, 0.0, 0.75, 50.0, 0), (0.0, 0.0, 0.0, None, 1), (0.0, 0.0, 0.0, 76.0, 0)]
    df = spark.createDataFrame(rows, "weighted_sentiment_score double, geopolitical_risk_score double, supply_shock_score double, rsi_14 double, want int").withColumns({"close": F.lit(3.0), "sma_20": F.lit(2.0), "sma_50": F.lit(1.0)})
    assert all(r.got == r.want for r in df.select("want", strategies.technical_news_filter().alias("got")).collect())
    assert df.where("rsi_14 is null").select(strategies.technical_news_filter(None).alias("got")).first().got == 0


def test_dense_features(spark):
    day = lambda n: dt.date(2026, 6, n)
    rel = spark.createDataFrame([("a", "GOLD", 0.9, True), ("b", "GOLD", 0.8, True), ("c", "GOLD", 0.1, False)], "article_id string, topic_id string, similarity_score double, is_relevant boolean")
    about = spark.createDataFrame([("a", day(27), "war in the red sea", "oil"), ("b", day(29), "calm", "metals"), ("c", day(28), "x", "metals")], "article_id string, date date, title string, category string").selectExpr("*", "date AS published_at", "'high' AS quality", "1 AS priority", "cast(null AS string) AS summary", "'' AS clean_text")
    mood = spark.createDataFrame([("a", 0.5, 1.0), ("b", -0.2, 1.4), ("c", 1.0, 1.0)], "article_id string, sentiment_score double, novelty_score double")
    got = news.news_features(news.article_signals(rel, about, mood)).orderBy("date").collect()
    assert [r.news_volume for r in got] == [1, 0, 1] and [r.news_acceleration for r in got] == [0, -1, 1] and got[1].news_pressure_score == 0
    assert got[0].news_pressure_score == pytest.approx(0.5 * 0.9 * 1.2) and got[0].geopolitical_risk_score == pytest.approx(0.5 * 0.9 * 1.2 * 2 / 3) and got[0].supply_shock_score == pytest.approx(0.5 * 0.9 * 1.2 * 0.35)
    assert got[2].weighted_sentiment_score == pytest.approx(-0.2)

    apart = news.article_signals(rel, about, mood, most_bytes=0)  # too many ids to send: all texts are scored where they are read
    assert apart.orderBy("article_id").collect() == news.article_signals(rel, about, mood).orderBy("article_id").collect()
    assert news.news_features(news.article_signals(rel.limit(0), about, mood)).count() == 0


def test_features_read_texts_once(spark):
    from barloom.plans import story

    d = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert plan(story.signals(spark, d)).count("text#") and "BroadcastHashJoin" in plan(story.signals(spark, d))
    assert "FileScan" not in plan(story.features(spark, d)) and "documents.parquet" not in plan(market.signals(spark, d))


def test_surprise(spark):
    s = series(spark, [1.0, 1.0, 5.0], name="v").withColumnRenamed("symbol", "k")
    assert [r.news_surprise for r in news.surprise(s, "v", ["k"], 2).orderBy("date").collect()] == [0, 0, 0]


def test_novelty_against_brute_force(spark):
    rows = [(1, DAY, "alpha beta gamma"), (2, DAY, "alpha beta delta"), (3, DAY + dt.timedelta(3), "alpha beta gamma"), (4, DAY + dt.timedelta(4), ""), (5, DAY + dt.timedelta(4), None), (6, DAY + dt.timedelta(40), "alpha beta gamma"), (7, DAY + dt.timedelta(41), "gamma beta alpha"), (8, DAY + dt.timedelta(41), "x")]
    df = spark.createDataFrame(rows, "article_id long, published date, clean_text string")
    token = lambda t: {w for w in (t or "").split() if len(w) > 2}
    for r in news.novelty(df, 20).collect():
        _, day, text = next(x for x in rows if x[0] == r.article_id)
        earlier = [token(t) for i, d, t in rows if 0 <= (day - d).days <= 20 and (d, i) < (day, r.article_id)]
        best = max([len(token(text) & e) / len(token(text) | e) for e in earlier if token(text) | e], default=0)
        assert r.novelty_score == pytest.approx(1 - best)


def test_clean_equity(spark):
    rows = [("A", "2024-01-01", 10.0, 9.0, 11.0, 10.0, 0), ("A", "2024-01-01", 10.0, 9.0, 11.0, 11.0, 1), ("CL=F", "2024-01-01", 1.0, 1.0, 1.0, -1.0, 0)]
    df = spark.createDataFrame(rows, "symbol string, date string, open double, high double, low double, close double, n long").withColumns({c: F.lit(None).cast("double") for c in ("adjusted_close", "volume", "dividends")})
    got = cleaning.clean_equity(df, F.col("n")).collect()
    assert [(r.symbol, r.close, r.high, r.low, r.dividends) for r in got] == [("A", 11.0, 11.0, 9.0, 0.0)]


def test_curves(spark):
    d = series(spark, [0.10, -0.05], name="net_return").withColumns({"strategy_name": F.lit("s"), "simple_return": F.lit(0.0)})
    bench = spark.createDataFrame([(DAY, 0.01)], "date date, daily_return double")
    traded = spark.createDataFrame([("A", "s")], "symbol string, strategy_name string")
    got = {r.series_type: r for r in portfolio.curve_metrics(portfolio.portfolio_curves(d, bench), traded).collect()}
    assert got["strategy"].final_equity == pytest.approx(104_500) and got["strategy"].cumulative_return == pytest.approx(0.045) and got["strategy"].trade_count == 1
    assert got["benchmark"].final_equity == pytest.approx(101_000) and got["strategy"].outperformance_vs_index == pytest.approx(0.035)


def test_sources(spark, tmp_path):
    p = str(tmp_path)
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    tables.append(df, f"{p}/t")
    tables.append(df, f"{p}/t")
    assert tables.scan(spark, f"{p}/t", ["k"], "k > 1").count() == 2
    tables.truncate(df, f"{p}/t")
    assert spark.read.parquet(f"{p}/t").count() == 2
    assert tables.ensure_table(spark, f"{p}/new", df.schema) and not tables.ensure_table(spark, f"{p}/new", df.schema)
    tables.write_csv(df, f"{p}/c")
    assert tables.scan_csv(spark, f"{p}/c", df.schema, ["v"]).collect() == [df.first()]
    with pytest.raises(ValueError, match="missing columns"):
        tables.scan_csv(spark, f"{p}/c", df.schema, ["w"])
    wide = spark.createDataFrame([(DAY, 1.0, 2.0)], "date date, `Adj Close|A` double, `Close|B` double")
    assert {(r.symbol, r.adjusted_close, r.close) for r in tables.wide_to_long(wide, ["date"]).collect()} == {("A", 1.0, None), ("B", None, 2.0)}
    (tmp_path / "feed.xml").write_text("<rss><channel><item><title>T</title><link>u</link><pubDate>Mon, 01 Jan 2024 02:00:00 +0200</pubDate></item><item><title>U</title><pubDate>01 Jan 2024 00:00:00 GMT</pubDate></item></channel></rss>")
    assert [str(r.published_at) for r in tables.parse_feed(spark, f"{p}/feed.xml").collect()] == ["2024-01-01 00:00:00"] * 2
    for day, rows in (("20240101", "k,v\n1,a\n"), ("20240102", "k,v\n2,b\n"), ("20240103", "k,v\n")):
        (tmp_path / f"market_data_{day}.csv").write_text(rows)
    assert [r.k for r in tables.latest_snapshot(spark, f"{p}/market_data_*.csv", df.schema).collect()] == [2]


def test_filters_and_runs(spark):
    df = spark.createDataFrame([("A", DAY, 1), ("B", DAY + dt.timedelta(1), 2)], "symbol string, date date, n int")
    assert staging.between(df, None, "2024-01-01").count() == 1 and staging.between(df).count() == 2
    assert staging.matching(df, symbol=["A"], missing=3, n=None).count() == 1
    with pytest.raises(ValueError, match="unknown symbols: Z"):
        staging.universe(df.withColumn("priority", F.lit("p")), symbols=["A", "Z"])
    log = spark.createDataFrame([("r", "a", "success", 1.0, 2), ("r", "b", "failed", 2.0, None), ("q", "a", "skipped", 1.0, 1)], "run_id string, task_name string, status string, duration_seconds double, rows_processed long")
    assert {r.run_id: (r.status, r.duration_seconds, r.rows_processed, r.error_message) for r in staging.run_status(log).collect()} == {"r": ("failed", 3.0, 2, "b"), "q": ("success", 1.0, 1, None)}
