"""Typed staging projections of the raw tables, each with its key rule, and the small dimensions beside them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.windows import latest_per_key

BENCHMARK = {
    "date": "date", "benchmark_id": "string", "benchmark_type": "string", "benchmark_name": "string", "component_id": "string", "component_symbol": "string", "component_name": "string", "category": "string", "priority": "string",
    "close_price": "double", "benchmark_level": "double", "daily_return": "double", "drawdown": "double", "actual_weight": "double", "target_weight": "double", "rebalance_executed": "boolean", "source": "string", "methodology": "string", "ingested_at": "timestamp",
}
NEWS = {
    "article_id": "string", "source_id": "string", "feed_id": "string", "source": "string", "feed_name": "string", "category": "string", "language": "string", "priority": "bigint", "quality": "string", "title": "string", "url": "string", "canonical_url": "string",
    "published_at": "timestamp", "summary": "string", "clean_text": "string", "content_hash": "string", "raw_content_hash": "string", "fetched_at": "timestamp", "ingested_at": "timestamp",
}
EMBEDDINGS = {"article_id": "string", "embedding": "array<double>", "embedding_dimension": "bigint", "embedding_model": "string", "embedding_model_version": "string", "created_at": "timestamp"}
SENTIMENT = {"article_id": "string", "positive_probability": "double", "neutral_probability": "double", "negative_probability": "double", "sentiment_score": "double", "novelty_score": "double", "sentiment_model": "string", "sentiment_model_version": "string", "calculated_at": "timestamp"}
RELEVANCE = {"article_id": "string", "commodity_id": "string", "commodity_symbol": "string", "commodity_name": "string", "similarity_score": "double", "is_relevant": "boolean", "relevance_threshold": "double", "embedding_model": "string", "calculated_at": "timestamp"}
LOGS = {"run_id": "string", "task_name": "string", "start_time": "timestamp", "end_time": "timestamp", "status": "string", "duration_seconds": "double", "rows_processed": "bigint", "error_message": "string"}


def typed(raw: DataFrame, types: Mapping[str, str], required: Sequence[str] = ()) -> DataFrame:
    """The columns that raw has of these, cast where they can be, the others NULL; rows that lack a required one are dropped."""
    out = raw.select(*((F.expr(f"try_cast(`{c}` AS {t})") if c in raw.columns else F.lit(None).cast(t)).alias(c) for c, t in types.items()))
    return out.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in required])) if required else out


def benchmarks(raw: DataFrame) -> DataFrame:
    """The row ingested last of each (date, benchmark, component); a missing component is a key of its own."""
    rows = typed(raw, BENCHMARK, ["date", "benchmark_id"]).withColumn("_component_", F.coalesce("component_id", F.lit("")))
    return latest_per_key(rows, ["date", "benchmark_id", "_component_"], [F.desc("ingested_at")]).drop("_component_")


def clean_benchmarks(raw: DataFrame, order: Column) -> DataFrame:
    """Typed, without NULL keys, the last row of each key by `order`."""
    rows = typed(raw.withColumn("_order_", order), {**BENCHMARK, "_order_": "bigint"}, ["date", "benchmark_id"]).withColumn("_component_", F.coalesce("component_id", F.lit("")))
    return latest_per_key(rows, ["date", "benchmark_id", "_component_"], [F.desc("_order_")]).drop("_component_", "_order_")


def news(raw: DataFrame) -> DataFrame:
    """The row ingested last of each article that has a title; published_at falls back to the time of fetching, then of ingestion."""
    rows = typed(raw, NEWS, ["article_id", "title"]).withColumn("published_at", F.coalesce("published_at", "fetched_at", "ingested_at"))
    return latest_per_key(rows.withColumn("published_date", F.to_date("published_at")), ["article_id"], [F.desc("ingested_at")])


def embeddings(raw: DataFrame) -> DataFrame:
    return typed(raw, EMBEDDINGS, ["article_id", "embedding"])


def of_model(rows: DataFrame, column: str, model: str | None, keys: Sequence[str]) -> DataFrame:
    """One model's rows, the one calculated last of each key. Without a model all rows stay, and a join with two models' rows gives each article twice."""
    return rows if model is None else latest_per_key(rows.where(F.col(column) == model), keys, [F.desc_nulls_last("calculated_at")])


def sentiment(raw: DataFrame, model: str | None = None) -> DataFrame:
    return of_model(typed(raw, SENTIMENT, ["article_id"]), "sentiment_model", model, ["article_id"])


def relevance(raw: DataFrame, model: str | None = None) -> DataFrame:
    return of_model(typed(raw, RELEVANCE, ["article_id", "commodity_id"]), "embedding_model", model, ["article_id", "commodity_id"])


def logs(raw: DataFrame) -> DataFrame:
    return typed(raw, LOGS, ["run_id", "task_name"])


def landing_views(spark: SparkSession, tables: Mapping[str, DataFrame], prefix: str = "landing_") -> None:
    """Each raw table as a temporary view."""
    for name, df in tables.items():
        df.createOrReplaceTempView(f"{prefix}{name}")


def universe(dimension: DataFrame, enabled: Column | None = None, priorities: Sequence[str] = (), symbols: Sequence[str] = ()) -> DataFrame:
    """The enabled rows of a dimension with these priorities and symbols, if any are named; a named symbol that it lacks raises."""
    out = dimension.where(enabled) if enabled is not None else dimension
    if symbols:
        known = {r["symbol"] for r in dimension.select("symbol").where(F.col("symbol").isin(*symbols)).distinct().collect()}  # of the named ones
        if unknown := sorted(set(symbols) - known):
            raise ValueError(f"unknown symbols: {', '.join(unknown)}")
        out = out.where(F.col("symbol").isin(*symbols))
    return out.where(F.col("priority").isin(*priorities)) if priorities else out


def reference_dim(instruments: DataFrame, search: str = "https://news.example.com/search?q=") -> DataFrame:
    """Instruments with the address of a news search for their name."""
    return instruments.withColumn("news_url", F.concat(F.lit(search), F.url_encode(F.concat(F.col("name"), F.lit(" price")))))


def between(df: DataFrame, start: str | None = None, end: str | None = None, date: str = "date") -> DataFrame:
    """Rows from start to end, both inclusive and both optional."""
    out = df.where(F.col(date) >= F.lit(start).cast("date")) if start else df
    return out.where(F.col(date) <= F.lit(end).cast("date")) if end else out


def matching(df: DataFrame, **values: object) -> DataFrame:
    """Rows whose columns have these values (or one of a list). A column that isn't there, or a value that is None or empty, filters nothing."""
    for c, v in values.items():
        if c in df.columns and v is not None and v != "" and v != []:
            df = df.where(F.col(c).isin(*v) if isinstance(v, list | tuple | set) else F.col(c) == v)
    return df


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values that aren't blank."""
    return df.select(column).where(F.trim(F.col(column).cast("string")) != "").distinct().orderBy(column)


def run_status(logs: DataFrame) -> DataFrame:
    """A row for each run: failed if a task neither succeeded nor was skipped, total seconds and rows, and the failed tasks by name."""
    failed = F.array_sort(F.collect_set(F.when(F.col("status") == "failed", F.col("task_name"))))
    out = logs.groupBy("run_id").agg(F.when(F.bool_and(F.coalesce(F.col("status").isin("success", "skipped"), F.lit(False))), "success").otherwise("failed").alias("status"), F.sum("duration_seconds").alias("duration_seconds"), F.coalesce(F.sum("rows_processed"), F.lit(0)).alias("rows_processed"), F.array_join(failed, ", ").alias("failed_tasks"))
    return out.withColumn("error_message", F.when(F.col("failed_tasks") != "", F.col("failed_tasks"))).drop("failed_tasks")
