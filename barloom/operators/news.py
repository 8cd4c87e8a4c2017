"""News features: relevance, signal components, daily aggregates, surprise, novelty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.functions import text as tx
from barloom.operators.similarity import best_before
from barloom.operators.windows import series
from barloom.sources.scratch import stored


def relevance(articles: DataFrame, topics: DataFrame, threshold: float = 0.35, most_bytes: int = 64 << 20) -> DataFrame:
    """Similarity of each article vector to each topic's. Topics are a reference dimension: all pairs are the result itself, and topics of over most_bytes raise."""
    size = topics.agg(F.sum(F.size("topic") * 8)).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes of topic vectors; at most {most_bytes} are sent to the tasks")
    sized = articles.select("article_id", "embedding", tx.norm(F.col("embedding")).alias("_na_"))  # norms once a vector, not once a pair
    pairs = sized.crossJoin(F.broadcast(topics.select("topic_id", "topic", tx.norm(F.col("topic")).alias("_nt_"))))  # checked above
    return pairs.select("article_id", "topic_id", tx.cosine(F.col("embedding"), F.col("topic"), F.col("_na_"), F.col("_nt_")).alias("similarity_score")).withColumn("is_relevant", F.col("similarity_score") >= threshold)


def article_signals(relevance: DataFrame, news: DataFrame, sentiment: DataFrame, most_bytes: int = 64 << 20) -> DataFrame:
    """Relevant articles with source weight, themes, freshness and the components of the daily features.

    Only articles that all three tables have. Freshness is counted to the article's own date, so it is 1 unless `news` has another `as_of`.
    The relevant pairs are stored once. If their ids take at most most_bytes they are sent to the tasks, which then score the
    themes of no other text; beyond that all texts are scored where they are read, so that texts never travel.
    """
    relevance = stored(relevance.where("is_relevant"))
    ids = relevance.select("article_id").distinct()
    if (ids.agg(F.sum(F.octet_length(F.col("article_id").cast("string")) + 24)).first()[0] or 0) <= most_bytes:
        news = news.join(F.broadcast(ids), "article_id", "left_semi")  # checked above
    as_of = F.col("as_of") if "as_of" in news.columns else F.col("date")
    about = news.select("article_id", "date", "published_at", as_of.alias("_as_of_"), tx.source_weight(F.col("quality"), F.col("priority")).alias("source_weight"), *(c.alias(n) for n, c in tx.theme_scores(F.col("category"), F.col("title"), F.col("summary"), F.col("clean_text")).items()))
    s = relevance.join(about, "article_id").join(sentiment.select("article_id", "sentiment_score", "novelty_score"), "article_id")
    s = s.withColumn("freshness_score", F.coalesce(tx.freshness(F.col("published_at"), F.col("_as_of_")), F.lit(1.0))).drop("_as_of_")
    s = s.withColumn("signal_weight", F.col("similarity_score") * F.col("source_weight") * F.col("freshness_score") * F.least(F.greatest("novelty_score", F.lit(0.0)), F.lit(1.0)))
    s = s.withColumns({"weighted_sentiment_component": F.col("sentiment_score") * F.col("signal_weight"), "pressure_component": F.abs("sentiment_score") * F.col("signal_weight")})
    return s.withColumns({f"{out}_component": F.col("pressure_component") * F.col(f"{theme}_theme_score") for out, theme in (("geopolitical_risk", "geopolitical"), ("supply_shock", "supply"), ("weather_risk", "weather"))})


FEATURES = ("news_volume", "relevant_news_volume", "weighted_sentiment_score", "avg_relevance_score", "avg_novelty_score", "sentiment_dispersion", "freshness_score", "source_weight", "news_pressure_score", "geopolitical_risk_score", "supply_shock_score", "weather_risk_score")


def daily_features(signals: DataFrame) -> DataFrame:
    """By topic and date: article counts, weighted sentiment, means, dispersion and the sums of pressure and risks; 0 where undefined. Rows without a date are left out."""
    mean, total = (lambda c: F.avg(c)), (lambda c: F.sum(c))
    w = F.sum("signal_weight")
    return signals.where("date IS NOT NULL").groupBy("topic_id", "date").agg(
        F.count_distinct("article_id").alias("news_volume"), F.count_distinct("article_id").alias("relevant_news_volume"), F.coalesce(F.try_divide(total("weighted_sentiment_component"), w), F.lit(0.0)).alias("weighted_sentiment_score"),
        mean("similarity_score").alias("avg_relevance_score"), mean("novelty_score").alias("avg_novelty_score"), F.coalesce(F.stddev_samp("sentiment_score"), F.lit(0.0)).alias("sentiment_dispersion"),
        mean("freshness_score").alias("freshness_score"), mean("source_weight").alias("source_weight"), total("pressure_component").alias("news_pressure_score"),
        total("geopolitical_risk_component").alias("geopolitical_risk_score"), total("supply_shock_component").alias("supply_shock_score"), total("weather_risk_component").alias("weather_risk_score"),
    )


def news_features(signals: DataFrame, window: int = 20) -> DataFrame:
    """The daily features on a dense grid of topics and days, with surprise and acceleration of the volume.

    The daily features are stored once: the grid reads them three times, and each time would score the articles anew.
    """
    grid = dense(stored(daily_features(signals)), ["topic_id"], FEATURES)
    return acceleration(surprise(grid, "news_volume", ["topic_id"], window), "news_volume", ["topic_id"])


def with_news(indicators: DataFrame, features: DataFrame, key: str = "symbol") -> DataFrame:
    """Indicators with the features of their symbol and date, 0 where there are none."""
    columns = [c for c in features.columns if c not in ("topic_id", "date")]
    of = features.withColumnRenamed("topic_id", key)
    return indicators.join(of.select(key, "date", *columns), [key, "date"], "left").fillna(0, columns)


def article_relevance(relevance: DataFrame, news: DataFrame, sentiment: DataFrame) -> DataFrame:
    """Relevance rows with what is known of their articles and sentiment; NULL where nothing is."""
    about = news.select("article_id", F.col("date").alias("published_date"), "source_id", "title")
    return relevance.join(about, "article_id", "left").join(sentiment.select("article_id", "sentiment_score", "novelty_score"), "article_id", "left")


def pending(articles: DataFrame, done: DataFrame, model: str | None = None) -> DataFrame:
    """Ids of articles that `done` lacks, each once; with a model, that `done` lacks for this embedding_model."""
    of = done.where(F.col("embedding_model") == model) if model is not None else done
    return articles.select("article_id").join(of.select("article_id"), "article_id", "left_anti").distinct()


def dense(features: DataFrame, keys: Sequence[str], columns: Sequence[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """A row for each key and each day from start to end (the first and last date of all unless given), 0 where there was none.

    Features have a row a key and date. Rows outside are left out, rows without a date too; NULL keys are keys like others.
    An empty table or span is empty.
    """
    dated = features.where("date IS NOT NULL")
    first, last = (F.lit(day).cast("date") if day else edge for day, edge in ((start, F.min("date")), (end, F.max("date"))))
    span = dated.agg(first.alias("_a_"), last.alias("_z_"))  # one row: two dates
    days = F.when(F.col("_a_") <= F.col("_z_"), F.sequence("_a_", "_z_"))
    rest = [c for c in features.columns if c not in (*keys, "date")]
    grid = dated.select(*keys).distinct().crossJoin(F.broadcast(span)).select(*keys, F.explode(days).alias("date"), F.lit(True).alias("_in_"))
    # grouping, unlike a join on equal keys, keeps NULL ones together
    both = grid.unionByName(dated, allowMissingColumns=True).groupBy(*keys, "date").agg(F.max("_in_").alias("_in_"), *(F.max(c).alias(c) for c in rest))
    return both.where("_in_").drop("_in_").fillna(0, list(columns))


def surprise(df: DataFrame, column: str, keys: Sequence[str], n: int = 20) -> DataFrame:
    """z-score against the n rows before: 0 where their deviation is 0 or undefined."""
    before = series(*keys).rowsBetween(-n, -1)
    x = F.col(column).cast("double")
    return df.withColumn("news_surprise", F.coalesce(F.try_divide(x - F.avg(x).over(before), F.stddev_samp(x).over(before)), F.lit(0.0)))


def acceleration(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    x = F.col(column).cast("double")
    return df.withColumn("news_acceleration", F.coalesce(x - F.lag(x).over(series(*keys)), F.lit(0.0)))


def novelty(articles: DataFrame, days: int = 20) -> DataFrame:
    """1 less the largest Jaccard similarity of tokens to an article of the `days` days before (by date, then id).

    Tokens and their sets are told apart by 64-bit hashes. Articles without tokens or without a date are new.
    """
    tokens = F.transform(tx.tokens(F.col("clean_text")), lambda x: F.xxhash64(x))
    best = best_before(articles.select(F.col("article_id").alias("id"), F.col("published").alias("at"), F.coalesce(tokens, F.array().cast("array<bigint>")).alias("t")), days)
    return best.select(F.col("id").alias("article_id"), (1 - F.col("s")).alias("novelty_score"))
