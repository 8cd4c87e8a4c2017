"""News features on the bars' symbols and dates, as frames and as SQL: what the trading rules and the news queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.functions import text as tx
from barloom.operators import news
from barloom.sources import adapters


#: Similarity from which a story counts as relevant; vectors of the tables are nearly independent of each other.
THRESHOLD = 0.05


def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.relevance(adapters.vectors(spark, sf_dir).select("article_id", "embedding"), adapters.symbol_topics(spark, sf_dir), THRESHOLD)


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.article_signals(relevance(spark, sf_dir), adapters.stories(spark, sf_dir), adapters.story_sentiment(spark, sf_dir))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.news_features(signals(spark, sf_dir))


def _hit(term: str) -> str:
    return f"contains(said, '{term}')::INT" if " " in term else rf"regexp_matches(said, '(^|[^\p{{L}}\p{{N}}_]){term}($|[^\p{{L}}\p{{N}}_])')::INT"


def _score(theme: str) -> str:
    return f"least(1.0::DOUBLE, ({' + '.join(map(_hit, tx.THEMES[theme]))}) / 3.0::DOUBLE)"


def _list(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{v}'" for v in values)


ENERGY, CROPS = (_list(names) for names, _ in tx.FLOORS)
QUALITY = "CASE lower(quality) " + " ".join(f"WHEN '{q}' THEN {w}" for q, w in tx.QUALITY_WEIGHTS.items()) + f" ELSE {tx.DEFAULT_QUALITY} END"
#: CTEs, to stand after others: stories, their themes and weights, relevance, signals and the dense daily features.
STORY = rf"""story0 AS (SELECT doc_id AS article_id, source AS source_id, ['oil', 'metals', 'Agriculture', 'energy_transition'][doc_id % 4 + 1] AS category, substr(string_split(text, chr(10))[1], 1, 80) AS title, text AS clean_text,
  ['very_high', 'HIGH', 'medium_high', 'medium', 'low', 'unknown'][doc_id % 6 + 1] AS quality, doc_id % 7 AS priority, DATE '1995-01-01' + CAST(doc_id * 7 % 2400 AS INT) AS date FROM documents),
story1 AS (SELECT *, lower(replace(category, '_', ' ')) AS cat, concat_ws(' ', nullif(lower(replace(category, '_', ' ')), ''), nullif(lower(replace(title, '_', ' ')), ''), nullif(lower(replace(clean_text, '_', ' ')), '')) AS said FROM story0),
story AS (SELECT *, {_score("geopolitical")} AS geopolitical_theme_score, greatest({_score("supply")}, CASE WHEN cat IN ({ENERGY}) THEN 0.35 WHEN cat IN ({CROPS}) THEN 0.25 ELSE 0 END)::DOUBLE AS supply_theme_score,
  greatest({_score("weather")}, CASE WHEN cat IN ({CROPS}) THEN 0.35 ELSE 0 END)::DOUBLE AS weather_theme_score, round(({QUALITY})::DOUBLE * (CASE WHEN priority > 0 THEN greatest(0.5, 1.2 - 0.1 * (priority - 1)) ELSE 0.75 END)::DOUBLE, 6) AS source_weight FROM story1),
feel AS (SELECT doc_id AS article_id, (doc_id * 37 % 100) / 100.0::DOUBLE - (doc_id * 53 % 100) / 100.0::DOUBLE AS sentiment_score, 1 - (doc_id % 10) / 20.0::DOUBLE AS novelty_score FROM documents),
vec AS (SELECT vec_id AS article_id, CAST(embedding AS DOUBLE[]) AS v, ['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'][label % 5 + 1] AS topic_id FROM embeddings),
top AS (SELECT topic_id, list(x ORDER BY i) AS topic FROM (SELECT topic_id, i, avg(x) AS x FROM (SELECT topic_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec) GROUP BY 1, 2) GROUP BY 1),
rel AS (SELECT vec.article_id, top.topic_id, list_cosine_similarity(v, topic) AS similarity_score FROM vec, top),
sgn0 AS (SELECT r.topic_id, article_id, s.date, r.similarity_score, s.source_weight, 1.0::DOUBLE AS freshness_score, f.sentiment_score, f.novelty_score, s.geopolitical_theme_score AS g, s.supply_theme_score AS u, s.weather_theme_score AS w,
  r.similarity_score * s.source_weight * least(greatest(f.novelty_score, 0), 1) AS signal_weight FROM rel r JOIN story s USING (article_id) JOIN feel f USING (article_id) WHERE r.similarity_score >= {THRESHOLD}),
sgn AS (SELECT *, sentiment_score * signal_weight AS weighted_sentiment_component, abs(sentiment_score) * signal_weight AS pressure_component FROM sgn0),
feat0 AS (SELECT topic_id, date, count(DISTINCT article_id) AS news_volume, coalesce(sum(weighted_sentiment_component) / nullif(sum(signal_weight), 0), 0) AS weighted_sentiment_score, avg(similarity_score) AS avg_relevance_score, avg(novelty_score) AS avg_novelty_score,
  coalesce(stddev_samp(sentiment_score), 0) AS sentiment_dispersion, avg(freshness_score) AS freshness_score, avg(source_weight) AS source_weight, sum(pressure_component) AS news_pressure_score,
  sum(pressure_component * g) AS geopolitical_risk_score, sum(pressure_component * u) AS supply_shock_score, sum(pressure_component * w) AS weather_risk_score FROM sgn GROUP BY 1, 2),
grid AS (SELECT topic_id, date FROM (SELECT DISTINCT topic_id FROM feat0), (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM feat0)),
feat1 AS (SELECT topic_id, date, coalesce(news_volume, 0) AS news_volume, {", ".join(f"coalesce({c}, 0) AS {c}" for c in news.FEATURES[2:])} FROM grid LEFT JOIN feat0 USING (topic_id, date)),
feat AS (SELECT *, coalesce((news_volume - avg(news_volume) OVER b) / nullif(stddev_samp(news_volume) OVER b, 0), 0) AS news_surprise, coalesce(news_volume - lag(news_volume) OVER (PARTITION BY topic_id ORDER BY date), 0)::DOUBLE AS news_acceleration
  FROM feat1 WINDOW b AS (PARTITION BY topic_id ORDER BY date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""
