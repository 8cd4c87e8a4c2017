"""Stored tables and files, benchmark rows, models, overview and scalars, by hand and against pandas."""

import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators import metrics, portfolio, staging
from barloom.sources import tables

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def test_csv_gives_back_what_was_written(spark, tmp_path):
    said = ["plain", "", None, " blanks outside ", 'a "quoted" word', '"', "two\nlines", "return\r\nand\rline", "comma, and\ttab", "back\\slash\\", '\\"', "ünïcode "]
    df = spark.createDataFrame(list(enumerate(said)), "k long, v string")
    tables.write_csv(df, f"{tmp_path}/c")
    assert {r.k: r.v for r in tables.scan_csv(spark, f"{tmp_path}/c", df.schema, ["k"]).collect()} == {k: v or None for k, v in enumerate(said)}


def test_entry_dates(spark):
    rows = [(1, "Mon, 01 Jan 2024 02:00:00 +0200", None), (2, "1 Jan 2024 00:00:00", None), (3, "soon", "2024-01-01T01:00:00+01:00"), (4, " 01 Jan 2024 00:00:00 GMT ", None), (5, "", "never"), (6, None, None)]
    df = spark.createDataFrame(rows, "k long, pubDate string, updated string").withColumn("created", F.lit(None).cast("string"))
    got = {r.k: r.t for r in df.select("k", F.unix_seconds(tables.published(F.col)).alias("t")).collect()}
    assert got == {1: 1704067200, 2: 1704067200, 3: 1704067200, 4: 1704067200, 5: None, 6: None}


def test_rows_of_one_model(spark):
    at = lambda n: dt.datetime(2024, 1, 1, n)
    raw = spark.createDataFrame([("a", "m1", 0.1, at(1)), ("a", "m1", 0.2, at(2)), ("a", "m1", 0.9, None), ("a", "m2", 0.3, at(3)), ("b", "m2", 0.4, at(1)), (None, "m1", 0.5, at(1))], "article_id string, sentiment_model string, sentiment_score double, calculated_at timestamp")
    assert [(r.article_id, r.sentiment_score) for r in staging.sentiment(raw, "m1").collect()] == [("a", 0.2)]
    assert staging.sentiment(raw).count() == 5 and staging.sentiment(raw, "m3").count() == 0


def test_external_benchmark(spark):
    df = spark.createDataFrame([(day(2), 30.0), (day(0), 20.0), (day(1), 40.0), (day(3), None), (None, 5.0)], "date date, close double")
    rows = portfolio.external_benchmark(df, "global_commodities", "X", "Name", "broad", "files").orderBy("date").collect()
    assert [(r.date, r.close_price, r.benchmark_level, r.drawdown, r.component_id) for r in rows] == [(day(0), 20.0, 100.0, 0.0, "GLOBAL"), (day(1), 40.0, 200.0, 0.0, "GLOBAL"), (day(2), 30.0, 150.0, -0.25, "GLOBAL")]
    assert [r.daily_return for r in rows] == [None, 1.0, -0.25] and rows[0].actual_weight is None
    assert portfolio.external_benchmark(df.where("close < 0"), "g", "X", "N", "b", "f").count() == 0
    zero = portfolio.external_benchmark(spark.createDataFrame([(day(0), 0.0), (day(1), 1.0)], "date date, close double"), "g", "X", "N", "b", "f")
    assert [r.benchmark_level for r in zero.collect()] == [None, None]


def test_stored_benchmarks_are_two_rows_a_bar_with_the_table_s_columns(spark):
    master = spark.createDataFrame([("GC=F", day(0), 5.0, 100.0, None, 100.0), ("GC=F", day(1), 6.0, 120.0, 0.2, 110.0)], "symbol string, date date, price double, asset_level double, asset_return double, index_level double")
    out = portfolio.stored_benchmarks(master, "src")
    assert out.columns == list(staging.BENCHMARK)
    assert {(r.date, r.benchmark_id, r.benchmark_level, r.daily_return) for r in out.collect()} == {(day(0), "buy_hold_gc=f", 100.0, None), (day(1), "buy_hold_gc=f", 120.0, 0.2), (day(0), portfolio.INDEX_ID, 100.0, None), (day(1), portfolio.INDEX_ID, 110.0, None)}
    whole = portfolio.stored_benchmarks(master.withColumns({"actual_weight": F.lit(0.5), "rebalance_executed": F.lit(True)}), "src").where("benchmark_type = 'synthetic_index'")
    assert {(r.actual_weight, r.target_weight, r.rebalance_executed) for r in whole.collect()} == {(0.5, None, True)}


def test_scalars_against_pandas_and_undefined_ones(spark):
    rng = np.random.default_rng(5)
    curve = 100 * np.cumprod(1 + rng.normal(0, 0.02, 300))
    rows = [("long", day(i), float(v)) for i, v in enumerate(curve)] + [("flat", day(i), 5.0) for i in range(4)] + [("one", day(0), 7.0), ("zero", day(0), 0.0), ("zero", day(1), 3.0), ("gap", day(0), None), ("up", day(0), 1.0), ("up", day(1), 2.0)]
    df = spark.createDataFrame(rows, "symbol string, date date, equity double")
    got = {r.symbol: r for r in metrics.equity_scalars(df, ["symbol"]).collect()}
    e = pd.Series(curve)
    r = e.pct_change().fillna(0)
    down, falls = r[r < 0].std() * math.sqrt(252), (e / e.cummax() - 1).min()
    yearly = (e.iloc[-1] / e.iloc[0]) ** (252 / 300) - 1
    want = {"cumulative_return": e.iloc[-1] / e.iloc[0] - 1, "annualized_return": yearly, "annualized_volatility": r.std() * math.sqrt(252), "sharpe_ratio": r.mean() * 252 / (r.std() * math.sqrt(252)), "sortino_ratio": r.mean() * 252 / down, "max_drawdown": falls, "calmar_ratio": yearly / -falls, "win_rate": (r > 0).mean(), "profit_factor": r[r > 0].sum() / -r[r < 0].sum()}
    assert all(math.isclose(got["long"][k], v, rel_tol=1e-9) for k, v in want.items())
    for name in ("flat", "one"):
        assert all(got[name][k] == 0 for k in want)
    assert got["up"]["profit_factor"] == math.inf and got["up"]["sortino_ratio"] == 0 and got["up"]["win_rate"] == 0.5
    assert got["zero"]["cumulative_return"] == 0 and got["zero"]["annualized_return"] == 0 and "gap" not in got
    trades = spark.createDataFrame([("a", day(0), 1.0, 0.5), ("a", day(1), 1.0, None), ("a", day(2), 1.0, -0.25), ("a", day(3), 1.0, 0.0)], "symbol string, date date, equity double, won double")
    by_trade = metrics.equity_scalars(trades, ["symbol"], trade_return="won").first()
    assert (round(by_trade.win_rate, 9), by_trade.profit_factor) == (round(1 / 3, 9), 2.0)


def test_overview_takes_the_strategy_of_the_latest_signal(spark):
    news = {c: F.lit(0.0) for c in metrics.OVERVIEW}
    signals = spark.createDataFrame([("A", day(0), "x", 1.0, 1), ("A", day(1), "y", 2.0, 0), ("A", day(1), "x", 2.0, 1), ("B", day(0), "z", 3.0, 1)], "symbol string, date date, strategy_name string, close double, signal int").withColumns(news)
    found = spark.createDataFrame([("A", "x", day(0), day(1), 2, 0.5), ("A", "y", day(0), day(1), 2, 0.7)], "symbol string, strategy_name string, first_date date, last_date date, days long, cumulative_return double")
    got = {r.symbol: (r.strategy_name, r.latest_date, r.latest_close, r.latest_signal, r.cumulative_return) for r in metrics.overview(signals, found).collect()}
    assert got == {"A": ("x", day(1), 2.0, 1, 0.5), "B": ("z", day(0), 3.0, 1, None)}


def test_appended_loads_keep_the_table_s_schema(spark, tmp_path):
    from barloom.operators.cleaning import align

    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.DoubleType()), T.StructField("day", T.StringType())])
    path = f"{tmp_path}/t"
    assert tables.ensure_table(spark, path, schema, ["day"])
    tables.append(align(spark.createDataFrame([("x", "2.5", "a")], "k string, v string, day string"), schema), path, ["day"])
    tables.append(align(spark.createDataFrame([("b", 7)], "day string, k int"), schema), path, ["day"])
    assert {tuple(r) for r in spark.read.schema(schema).parquet(path).collect()} == {(None, 2.5, "a"), (7, None, "b")}
