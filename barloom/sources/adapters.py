"""Domain tables derived from the driver's tables: bars, events as bars, articles, vectors, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def bars_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by order priority: prices are order totals in thousands, volume the number of orders."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date"), (F.col("o_totalprice") / 1000).alias("p"), F.struct("o_orderdate", "o_orderkey", "o_totalprice").alias("at"))
    return o.groupBy("symbol", "date").agg(F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"), F.count("*").cast("double").alias("volume"))


def bars_lineitem(spark: SparkSession, sf_dir: str, symbol: Column | None = None) -> DataFrame:
    """Daily bars of unit prices, by return flag and line status unless another symbol is given."""
    key = F.concat("l_returnflag", "l_linestatus") if symbol is None else symbol
    li = read(spark, sf_dir, "lineitem").select(key.cast("string").alias("symbol"), F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("p"), "l_quantity", F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("at"))
    li = li if symbol is None else li.repartition("symbol")  # of many symbols few rows share a bar, and all that follows is by symbol
    return li.groupBy("symbol", "date").agg(F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", "at").alias("close"), F.sum("l_quantity").alias("volume"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    q = F.when(F.col("doc_id") % 5 == 0, "very_high").when(F.col("doc_id") % 5 == 1, "high").when(F.col("doc_id") % 5 == 2, "medium").when(F.col("doc_id") % 5 == 3, "low")
    return d.select(F.col("doc_id").alias("article_id"), F.substring(F.split("text", "\n")[0], 1, 80).alias("title"), F.col("text").alias("clean_text"), F.col("source").alias("source_id"), F.col("lang").alias("language"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 60).cast("int")).alias("published"), (1 + F.col("doc_id") % 5).alias("priority"), q.alias("quality"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("article_id"), "embedding", F.col("label"))


def topic_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of each label."""
    e = vectors(spark, sf_dir).select("label", F.posexplode("embedding").alias("i", "v"))
    m = e.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return m.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("topic"))


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as dated news over the span of the bars: category, title, quality and priority by id."""
    d, i = read(spark, sf_dir, "documents"), F.col("doc_id")
    pick = lambda n, *names: F.element_at(F.array(*(F.lit(x) for x in names)), (i % n + 1).cast("int"))
    day = F.date_add(F.lit("1995-01-01").cast("date"), (i * 7 % 2400).cast("int"))
    return d.select(i.alias("article_id"), F.col("source").alias("source_id"), pick(4, "oil", "metals", "Agriculture", "energy_transition").alias("category"), F.substring(F.split("text", "\n")[0], 1, 80).alias("title"), F.lit(None).cast("string").alias("summary"), F.col("text").alias("clean_text"), pick(6, "very_high", "HIGH", "medium_high", "medium", "low", "unknown").alias("quality"), (i % 7).alias("priority"), day.alias("date"), day.alias("published_at"))


def story_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stands for the stored sentiment of the stories: scores by id."""
    i = F.col("doc_id")
    return read(spark, sf_dir, "documents").select(i.alias("article_id"), ((i * 37 % 100) / 100.0).alias("positive_probability"), ((i * 53 % 100) / 100.0).alias("negative_probability"), (1 - (i % 10) / 20.0).alias("novelty_score")).withColumn("sentiment_score", F.col("positive_probability") - F.col("negative_probability"))


def symbol_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean vector of every fifth label, named by the symbols of the bars."""
    names = F.array(*(F.lit(x) for x in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")))
    e = vectors(spark, sf_dir).select(F.element_at(names, (F.col("label") % 5 + 1).cast("int")).alias("topic_id"), F.posexplode("embedding").alias("i", "v"))
    m = e.groupBy("topic_id", "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return m.groupBy("topic_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda x: x["v"]).alias("topic"))


def raw_benchmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as stored benchmark rows: the ship date, two ids, a component or none, a level and a return."""
    part = F.nullif(F.col("l_linenumber").cast("string"), F.lit("1"))
    kind = F.when(F.col("l_linestatus") == "O", "synthetic").otherwise("buy_and_hold")
    return read(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("date"), F.when(F.col("l_returnflag") == "R", "synthetic_commodity_index").otherwise(F.col("l_returnflag")).alias("benchmark_id"), kind.alias("benchmark_type"), part.alias("component_id"), F.col("l_extendedprice").alias("benchmark_level"), (F.col("l_discount") - 0.05).alias("daily_return"), F.timestamp_seconds("l_orderkey").alias("ingested_at"))


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a pipeline's task log: a run for each user, a task for each event type."""
    status = F.when(F.col("value") > 60, "failed").when(F.col("event_id") % 9 == 0, "skipped").otherwise("success")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("task_name"), F.col("ts").alias("start_time"), status.alias("status"), F.col("value").alias("duration_seconds"), (F.col("event_id") % 100).alias("rows_processed"))
