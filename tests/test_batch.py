"""Batch jobs by hand and against brute force: similarity in a window, correlations, embeddings, long series, indices, conversion, feeds, counters, calendars."""

import datetime as dt
import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from barloom.functions import text as tx
from barloom.operators import calendars, cleaning, embeddings, fx, index, indicators, metrics, news, scans, similarity
from barloom.sources import adapters, tables

SF = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def best_by_hand(rows, days):
    out = {}
    for i, at, t in rows:
        s = 0.0
        for j, then, u in rows:
            if at is not None and then is not None and 0 <= (at - then).days <= days and (then < at or j < i) and (t or u):
                s = max(s, len(set(t) & set(u)) / len(set(t) | set(u)) if t and u else 0.0)
        out[i] = round(s, 9)
    return out


@pytest.mark.parametrize("chunk, near", [(1024, 0.5), (7, 0.5), (7, 0.95), (1024, 0.1)])
def test_best_match_before_against_all_pairs(spark, chunk, near):
    rng, rows = random.Random(chunk), []
    for i in range(150):
        t = rng.sample(range(60), rng.randrange(0, 12))
        if i % 4 == 1 and rows:  # a near copy
            t = list(rng.choice(rows)[2])
            t = t[1:] + [70 + i] if i % 8 == 1 and t else t
        rows.append((i * 7 % 150, None if i % 29 == 3 else day(rng.randrange(0, 40)), t))
    table = spark.createDataFrame(rows, "id long, at date, t array<bigint>")
    assert {r.id: round(r.s, 9) for r in similarity.best_before(table, 10, near, chunk).collect()} == best_by_hand(rows, 10)


def test_best_match_of_text_ids_and_of_nothing(spark):
    table = spark.createDataFrame([("b", DAY, [1, 2]), ("a", DAY, [2, 3])], "id string, at date, t array<bigint>")
    assert {r.id: round(r.s, 6) for r in similarity.best_before(table, 3).collect()} == {"a": 0.0, "b": round(1 / 3, 6)}
    assert similarity.best_before(table.where("1 = 0"), 3).count() == 0


def shuffled_mb(spark):
    """MB that the session's stages have written to shuffles so far."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size())) / 1e6


def test_disk_of_best_match_follows_the_sets(spark):
    """Chunks that meet are read, not sent: the shuffle doesn't grow with the square of the chunks in a window."""
    mb = []
    for n in (400, 1600):
        table = spark.range(n).select("id", F.lit(DAY).alias("at"), F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.xxhash64("id", i % 39)).alias("t"))
        before = shuffled_mb(spark)
        assert similarity.best_before(table.withColumn("t", F.array_distinct("t")), 3, 0.5, 16).count() == n
        mb.append(shuffled_mb(spark) - before)
    assert mb[1] < 6 * mb[0]  # 4 times the sets


def test_overlaps_in_both_ways():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.zipf(1.3, 60) % 400) for _ in range(90)]
    by_hand = [[len(np.intersect1d(a, b)) for b in sets[:40]] for a in sets]
    assert (similarity.overlaps(sets, sets[:40], columns=16) == by_hand).all()


@pytest.mark.parametrize("blocks", [(512, 2048), (3, 20), (1, 5)])
def test_correlations_against_pandas(spark, blocks):
    rng = np.random.default_rng(2)
    wide = pd.DataFrame(rng.normal(5, 1, (60, 9)), index=[day(3 * i) for i in range(60)], columns=[f"S{i}" for i in range(9)])
    wide["S1"] = -2 * wide["S0"] + 0.1 * wide["S1"]
    wide = wide.mask(rng.random(wide.shape) < 0.3)
    wide["S8"] = 7.0  # never moves
    wide.iloc[:, 7] = np.nan
    rows = [(s, d, None if np.isnan(v) else float(v)) for s in wide for d, v in wide[s].items()]
    got = {(r.symbol_a, r.symbol_b): (r.correlation, r.n) for r in metrics.correlations(spark.createDataFrame(rows, "symbol string, date date, simple_return double"), block_symbols=blocks[0], block_dates=blocks[1]).collect()}
    for a in wide:
        for b in wide:
            n = int((wide[a].notna() & wide[b].notna()).sum())
            if a <= b:
                assert got.get((a, b), (None, 0))[1] == n
            if a <= b and n and "S8" not in (a, b):
                assert got[a, b][0] == pytest.approx(wide[a].corr(wide[b]), abs=1e-9)
    assert got["S8", "S8"][0] is None


def test_embeddings_only_of_what_is_pending_and_one_encoder_a_task(spark, tmp_path):
    articles = spark.createDataFrame([(i, f"title {i}", f"text {i}" if i % 3 else None) for i in range(40)] + [(3, "again", "x"), (None, "no id", "x")], "article_id long, title string, clean_text string").repartition(3)
    log = str(tmp_path / "built")

    def make():
        with open(log, "a") as f:
            f.write("built\n")
        return embeddings.byte_bucket_encoder(4)

    first = embeddings.create_embeddings(articles, make, "m", "1", batch=4).persist()
    assert first.count() == 40 and {r.embedding_dimension for r in first.collect()} == {4}
    assert 1 <= open(log).read().count("built") <= spark.sparkContext.defaultParallelism
    built = open(log).read()
    again = embeddings.create_embeddings(articles, make, "m", "1", done=first)
    assert again.count() == 0 and open(log).read() == built  # nothing pending, nothing built
    assert embeddings.create_embeddings(articles, make, "another", "1", done=first).count() == 40
    with pytest.raises(Exception, match="vectors for"):
        embeddings.create_embeddings(articles, lambda: lambda batch: [], "m", "1").collect()
    v = embeddings.byte_bucket_encoder(4)(["abé", ""])
    raw = np.zeros(4)
    for i, b in enumerate("abé".encode()):
        raw[i % 4] += b
    assert v[0] == pytest.approx(raw / np.linalg.norm(raw)) and (v[1] == 0).all()
    one = spark.createDataFrame([("abé",), ("",), (None,)], "t string").select(tx.byte_buckets(F.col("t"), 4).alias("v")).collect()
    assert one[0].v == pytest.approx(list(v[0])) and one[1].v == [0.0] * 4


def test_byte_buckets_read_each_byte_once(spark):
    """Without lambdas over the places of a text, which were run once for each bucket."""
    texts = spark.createDataFrame([("Grüße €" * n,) for n in range(5)] + [(None,)], "t string")
    out = texts.select("t", tx.byte_buckets(F.col("t")).alias("v"))
    for r in out.collect():
        raw = np.zeros(8)
        for i, b in enumerate((r.t or "").encode()):
            raw[i % 8] += b
        assert r.v == pytest.approx(list(raw / (np.linalg.norm(raw) or 1)))
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("chunk", [170, 400, 5000])
def test_means_of_long_series_equal_those_of_whole_ones(spark, chunk):
    rng = np.random.default_rng(chunk)
    rows = [(s, day(int(i * (1 + len(s)))), float(v)) for s, n in (("A", 1300), ("BB", 30), ("C", 1)) for i, v in enumerate(100 + rng.normal(0, 1, n).cumsum())]
    bars = spark.createDataFrame(rows, "symbol string, date date, close double")
    for whole, parts in ((indicators.macd_kernel, scans.macd_kernel_scan), (indicators.macd_recursive, scans.macd_recursive_scan)):
        a, b = (sorted(tuple(r) for r in f.collect()) for f in (whole(bars), parts(bars, chunk_rows=chunk)))
        assert [r[:2] for r in a] == [r[:2] for r in b]
        for x, y in zip(a, b):
            shown = lambda r: [float("nan") if v is None else v for v in r[2:]]
            assert shown(x) == pytest.approx(shown(y), rel=1e-9, abs=1e-9, nan_ok=True)


def test_a_long_series_is_many_tasks(spark):
    """200,000 rows of one symbol, places from stretches; a missing price raises."""
    bars = spark.range(200_000).select(F.lit("A").alias("symbol"), F.date_add(F.lit("1500-01-01").cast("date"), F.col("id").cast("int")).alias("date"), (F.col("id") % 100 + 1.0).alias("close"))
    p = scans.placed(bars).agg(F.count_distinct("pos").alias("n"), F.max("pos").alias("last"), F.corr("pos", F.unix_date("date")).alias("r")).first()
    assert (p.n, p.last) == (200_000, 199_999) and p.r == pytest.approx(1)
    assert scans.macd_recursive_scan(bars, chunk_rows=20_000).where("macd_signal IS NULL").count() == 33
    with pytest.raises(Exception, match="needs a price"):
        scans.placed(bars.withColumn("close", F.when(F.col("date") != "1600-01-01", F.col("close")))).collect()


def test_index_history_against_a_loop(spark):
    rng = np.random.default_rng(4)
    days = [day(i) for i in range(200)]
    prices = np.exp(rng.normal(0, 0.02, (200, 3)).cumsum(axis=0)) * [10, 20, 30]
    prices[31, 1] = -0.5  # first day of February: no rebalance
    panel = spark.createDataFrame([(d, f"S{j}", float(prices[i, j])) for i, d in enumerate(days) for j in range(3)], "date date, symbol string, price double")
    got, weights = (f.collect() for f in index.index_history(panel, "month", 100.0, 25.0))
    got = {r.date: r for r in got}
    held = {(r.date, r.symbol): r for r in weights}
    units, before, peak = None, None, 0.0
    for i, d in enumerate(days):
        asked = i == 0 or d.month != days[i - 1].month
        gross = level = 100.0 if units is None else float(units @ prices[i])
        turnover, done = 0.0, asked and (prices[i] > 0).all()
        if units is None:
            units = level / 3 / prices[i]
        elif done:
            turnover = 0.5 * np.abs(1 / 3 - units * prices[i] / gross).sum()
            level = gross * (1 - turnover * 25 / 1e4)
            units = level / 3 / prices[i]
        peak, r = max(peak, level), got[d]
        assert (r.gross_level, r.level, r.turnover, r.transaction_cost) == pytest.approx((gross, level, turnover, gross - level), abs=1e-8)
        assert (r.rebalance_requested, r.rebalance_executed, r.rebalance_skipped) == (asked, done, asked and not done)
        assert r.drawdown == pytest.approx(level / peak - 1) and (r.daily_return is None if before is None else r.daily_return == pytest.approx(level / before - 1))
        for j in range(3):
            w = held[d, f"S{j}"]
            assert w.actual_weight == pytest.approx(units[j] * prices[i, j] / (units @ prices[i])) and (w.target_weight is not None) == done
        before = level


def test_local_portfolio(spark):
    panel = spark.createDataFrame([("A", day(0), 10.0), ("A", day(1), 11.0), ("B", day(0), 20.0), ("B", day(1), 18.0)], "symbol string, date date, price double")
    assert [round(r.level, 6) for r in index.local_portfolio(panel).orderBy("date").collect()] == [100.0, 100.0]
    more = spark.createDataFrame([("A", day(2), 99.0), ("B", day(2), None), ("A", day(3), 5.5), ("B", day(3), 18.0), ("C", day(3), None)], panel.schema)
    got = index.local_portfolio(panel.union(more)).orderBy("date").collect()  # day 2 isn't whole, C has no price
    assert [(r.date, round(r.daily_return, 6), round(r.drawdown, 6)) for r in got] == [(day(0), 0, 0), (day(1), 0, 0), (day(3), -0.25, -0.25)]
    assert index.local_portfolio(panel.limit(0)).count() == 0


def test_conversion(spark):
    prices = spark.createDataFrame([("D", "USD", day(i), 100.0 + i) for i in range(3)] + [("E", "EUR", day(0), 5.0), ("G", "GBP", day(9), 8.0), ("J", "JPY", day(0), 1.0), ("N", None, day(0), 1.0)], "symbol string, currency string, date date, price double")
    quotes = spark.createDataFrame([("USD", "EUR", day(0), 0.9), ("EUR", "USD", day(0), 2.0), ("EUR", "GBP", day(0), 0.8), ("JPY", "EUR", day(0), 0.0)], "base string, quote string, date date, rate double")
    good, lacking = fx.converted(prices, quotes, "EUR")
    got = {(r.symbol, r.date): r.converted for r in good.collect()}
    assert [got["D", day(i)] for i in range(3)] == pytest.approx([90.0, 90.9, 91.8])
    assert got["E", day(0)] == 5.0 and got["G", day(9)] == pytest.approx(10.0) and len(got) == 5
    assert {r.currency for r in lacking.collect()} == {"JPY", None} and fx.converted(prices.where("currency = 'EUR'"), quotes, "EUR")[1].count() == 0
    old = spark.createDataFrame([("D", "USD", day(i), 1.0) for i in range(8)], prices.schema)
    assert [r.converted for r in fx.converted(old, quotes, "EUR", 5)[0].orderBy("date").collect()] == [0.9] * 6 + [None] * 2


def test_feed_articles_and_what_is_malformed(spark):
    item = lambda link, said: f"<item><title>Gold rises on weaker dollar</title><link>https://example.com/article?{link}</link><pubDate>Mon, 29 Jun 2026 08:00:00 GMT</pubDate><description><![CDATA[{said}]]></description></item>"
    rows = [("f", item("utm_source=rss&amp;id=123", "<p>Gold <b>prices</b> moved higher.</p>")), ("f", item("id=123", "<p>Gold prices moved higher.</p>")), ("f", "<item><title>open"), ("f", None), ("other", item("id=1", "x")), ("f", "<item></item>")]
    feeds = spark.createDataFrame([("f", "src", "Source", "Feed", "metals", "en", 2, "high")], "feed_id string, source_id string, source string, feed_name string, category string, language string, priority int, quality string")
    good, bad = tables.feed_articles(spark.createDataFrame(rows, "feed_id string, item string"), feeds)
    got = good.where("title <> ''").collect()
    assert len(got) == 2 and len({r.article_id for r in got}) == len({r.content_hash for r in got}) == 1 and len({r.raw_content_hash for r in got}) == 2
    assert {(r.title, r.clean_text, r.canonical_url, str(r.published_at)) for r in got} == {("Gold rises on weaker dollar", "Gold prices moved higher.", "https://example.com/article?id=123", "2026-06-29 08:00:00")}
    assert got[0].content_hash == hashlib.sha256(b"gold rises on weaker dollar|gold prices moved higher.").hexdigest()
    assert sorted((r.feed_id, r.error) for r in bad.collect()) == [("f", "malformed item"), ("f", "malformed item"), ("other", "unknown feed")]
    assert cleaning.clean_news(good, F.col("published_at")).count() == 1


def test_panel_of_a_universe(spark, tmp_path):
    (tmp_path / "m.csv").write_text("symbol,date,close,ingested_at\nB,2024-01-02,2,a\nB,2024-01-02,3,b\nA,2024-01-01,1,a\nA,no,9,a\nC,2024-01-01,7,a\nA,2024-01-02,x,a\n")
    got = tables.scan_market_csv(spark, str(tmp_path / "m.csv"), ["B", "A"]).orderBy("date")
    assert got.columns == ["date", "B", "A"] and [tuple(r)[1:] for r in got.collect()] == [(None, 1.0), (3.0, None)]
    with pytest.raises(ValueError, match="no prices of Z"):
        tables.scan_market_csv(spark, str(tmp_path / "m.csv"), ["A", "Z"])


def test_counters_by_observation_and_by_symbol(spark, tmp_path):
    n = None
    rows = [("A", day(0), 1, 5.0, 4.0, 3.0, 6.0, 6.0, 1.0), ("A", day(0), 0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0), ("A", day(1), 1, n, n, n, n, n, 1.0), ("A", day(2), 1, 1.0, 1.0, 1.0, n, 1.0, n), ("A", n, 1, 1.0, 1.0, 1.0, 1.0, 1.0, n), ("B", day(0), 1, -1.0, 2.0, 1.0, 1.0, 1.0, 1.0), ("B", day(3), 1, n, 2.0, 1.0, 1.0, 1.0, 1.0)]
    raw = spark.createDataFrame(rows, "symbol string, date date, k int, open double, high double, low double, close double, adjusted_close double, volume double")
    judged = cleaning.judged(raw, F.col("k"))
    a, b = cleaning.quality_counters(judged).orderBy("symbol").collect()
    assert (a.rows_downloaded, a.rows_after_cleaning, a.duplicate_dates_removed, a.empty_rows_dropped, a.ohlc_inconsistent_rows_fixed, a.close_missing, a.volume_missing, a.first_date) == (5, 1, 1, 1, 1, 1, 1, day(0))
    assert (b.rows_after_cleaning, b.non_positive_price_rows_dropped, b.open_missing, b.last_date) == (1, 1, 1, day(3))
    seen = Observation("counters")
    cleaning.mended(judged, seen).write.parquet(str(tmp_path / "clean"))
    assert seen.get["rows_downloaded"] == 7 and seen.get["rows_after_cleaning"] == 2 and seen.get["duplicate_dates_removed"] == 1
    assert [(r.high, r.low) for r in spark.read.parquet(str(tmp_path / "clean")).where("symbol = 'A'").collect()] == [(6.0, 3.0)]
    assert {(r["column"], r.missing_before, r.missing_after) for r in cleaning.missing_report(judged, cleaning.mended(judged), ["open", "close"]).collect()} == {("open", 2, 1), ("close", 2, 0)}


def test_calendars_against_pandas(spark):
    for kind, freq in (("day", "D"), ("business", "B"), ("month_end", "ME"), ("quarter_end", "QE"), ("year_end", "YE"), ("month_start", "MS"), ("quarter_start", "QS"), ("year_start", "YS")):
        got = [r.date for r in calendars.calendar(spark, "2023-12-30", "2026-03-31", kind).orderBy("date").collect()]
        assert got == [t.date() for t in pd.date_range("2023-12-30", "2026-03-31", freq=freq)], kind
    assert calendars.calendar(spark, "2024-01-02", "2024-01-01").count() == 0
    with pytest.raises(ValueError, match="no calendar"):
        calendars.calendar(spark, "2024-01-01", "2024-01-02", "lunar")


def test_periods_last_match_wins(spark):
    periods = spark.createDataFrame([(1, "a", "tune", True, day(0), day(5)), (2, "b", "test", False, day(4), None)], "position int, period string, purpose string, optimisable boolean, first date, last date")
    rows = spark.createDataFrame([(day(-1),), (day(3),), (day(4),), (day(900),)], "date date")
    assert [(r.period, r.purpose, r.optimisable) for r in metrics.with_periods(rows, periods).orderBy("date").collect()] == [("out_of_scope", None, False), ("a", "tune", True), ("b", "test", False), ("b", "test", False)]
    with pytest.raises(ValueError, match="periods"):
        metrics.with_periods(rows, periods, most=1)


def test_dense_grid_of_null_keys_and_a_span(spark):
    rows = spark.createDataFrame([(None, day(1), 4), ("k", day(9), 5), ("k", None, 6)], "key string, date date, n long")
    got = {(r.key, r.date): r.n for r in news.dense(rows, ["key"], ["n"], str(day(0)), str(day(2))).collect()}
    assert got == {(k, day(i)): 4 if (k, i) == (None, 1) else 0 for k in (None, "k") for i in range(3)}
    assert news.dense(rows, ["key"], ["n"], str(day(2)), str(day(1))).count() == 0


def test_pages_come_out_without_markup(spark):
    rows = adapters.read(spark, SF, "pages").select("html", tx.clean_html(F.col("html")).alias("t")).collect()
    assert rows and all("<script" not in r.t and "</" not in r.t and "  " not in r.t for r in rows if r.t is not None)
    assert sum(len(r.t or "") for r in rows) > 1000


def test_source_freshness(spark):
    t = spark.createDataFrame([("2024-01-01 00:00:00",)], "loaded string").select(F.col("loaded").cast("timestamp").alias("loaded"))
    states = [cleaning.freshness_status(t, F.lit(now).cast("date"), "loaded").first().status for now in ("2024-01-02", "2024-01-05", "2024-01-09")]
    assert states == ["pass", "warn", "error"]


def test_news_ties_and_snapshots_without_rows(spark, tmp_path):
    rows = [("a", " x ", "h1", 1), ("a", "y", "h2", 1), ("b", "z", "h2", 1), ("c", " ", "h3", 9), (None, "t", "h4", 1), ("d", "t", None, 1)]
    raw = spark.createDataFrame(rows, "article_id string, title string, content_hash string, at int")
    want = [("b", "z", "h2", 1)]  # of a's rows the larger hash, of h2's the larger id
    for some in (raw, raw.orderBy(F.desc("title")).repartition(3)):
        assert [tuple(r) for r in cleaning.clean_news(some, F.col("at")).select(*raw.columns).collect()] == want
    for day in ("20240101", "20240102"):
        (tmp_path / f"m_{day}.csv").write_text("k\n")
    empty = tables.latest_snapshot(spark, f"{tmp_path}/m_*.csv", raw.select(F.col("at").alias("k")).schema)
    assert empty.columns == ["k"] and empty.count() == 0
    (tmp_path / "m_20231231.csv").write_text("k\n7\n")
    assert [r.k for r in tables.latest_snapshot(spark, f"{tmp_path}/m_*.csv", empty.schema).collect()] == [7]
