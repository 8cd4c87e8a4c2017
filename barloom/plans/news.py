"""Registered queries over articles, pages and vectors, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.functions import text as tx
from barloom.operators import cleaning, embeddings, news, portfolio
from barloom.plans import story
from barloom.plans.market import query
from barloom.plans.story import STORY
from barloom.sources import adapters

ART = """WITH art AS (SELECT doc_id AS article_id, text AS clean_text, source AS source_id, DATE '2024-01-01' + CAST(doc_id % 60 AS INT) AS published, 1 + doc_id % 5 AS priority,
  CASE doc_id % 5 WHEN 0 THEN 1.2 WHEN 1 THEN 1.0 WHEN 2 THEN 0.7 WHEN 3 THEN 0.5 ELSE 0.75 END::DOUBLE AS base FROM documents)"""


@query("TXT3_sha256_ids", "SELECT doc_id AS article_id, sha256(source || '|' || coalesce(text, '')) AS content_hash FROM documents")
def _(s, d):
    return adapters.articles(s, d).select("article_id", tx.joined_hash(F.col("source_id"), F.col("clean_text")).alias("content_hash"))


@query("TXT7_tokenize", "SELECT doc_id AS article_id, len(list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z][a-zA-Z0-9_+-]{2,}'), lambda x: lower(x))))::BIGINT AS tokens FROM documents")
def _(s, d):
    return adapters.articles(s, d).select("article_id", F.size(tx.tokens(F.col("clean_text"))).alias("tokens"))


def hits(terms: tuple[str, ...]) -> str:
    return " + ".join(f"contains(lower(clean_text), '{t}')::INT" for t in terms)


@query("TXT9_lexicon_sentiment", ART + f""", h AS (SELECT article_id, {hits(("ing", "the ", "er"))} AS p, {hits(("and", "tion", "ess"))} AS n FROM art)
SELECT article_id, CASE WHEN p > n THEN 0.7 WHEN n > p THEN 0.1 ELSE 0.2 END::DOUBLE AS positive, CASE WHEN p <> n THEN 0.2 ELSE 0.6 END::DOUBLE AS neutral, CASE WHEN p > n THEN 0.1 WHEN n > p THEN 0.7 ELSE 0.2 END::DOUBLE AS negative FROM h""")
def _(s, d):
    return adapters.articles(s, d).select("article_id", tx.lexicon_sentiment(F.col("clean_text"), ("ing", "the ", "er"), ("and", "tion", "ess")).alias("x")).select("article_id", "x.*")


@query("TXT12_source_weight", "WITH " + STORY + " SELECT article_id, round(source_weight, 6) AS weight FROM story")
def _(s, d):
    return adapters.stories(s, d).select("article_id", tx.source_weight(F.col("quality"), F.col("priority")).alias("weight"))


@query("TXT13_freshness", ART + " SELECT article_id, round(1.0 / (1 + greatest(DATE '2024-02-15' - published, 0)), 6) AS freshness FROM art")
def _(s, d):
    return adapters.articles(s, d).select("article_id", tx.freshness(F.col("published"), F.lit("2024-02-15").cast("date")).alias("freshness"))


@query("TXT8_novelty", ART + """, t AS (SELECT article_id, published, unnest(list_distinct(list_transform(regexp_extract_all(clean_text, '[a-zA-Z][a-zA-Z0-9_+-]{2,}'), lambda x: lower(x)))) AS token FROM art), n AS (SELECT article_id, count(*) AS n FROM t GROUP BY 1),
k AS (SELECT a.article_id, b.article_id AS other, count(*) AS k FROM t a JOIN t b ON a.token = b.token AND b.published BETWEEN a.published - 20 AND a.published AND (b.published < a.published OR b.article_id < a.article_id) GROUP BY 1, 2)
SELECT art.article_id, round(1 - coalesce(max(k / (na.n + nb.n - k)), 0), 6) AS novelty_score FROM art LEFT JOIN k USING (article_id) LEFT JOIN n na ON na.article_id = art.article_id LEFT JOIN n nb ON nb.article_id = k.other GROUP BY 1""")
def _(s, d):
    return news.novelty(adapters.articles(s, d), 20)


@query("VEC3_relevance", "WITH " + STORY + " SELECT article_id, topic_id, round(similarity_score, 6) + 0.0 AS similarity_score, similarity_score >= " + str(story.THRESHOLD) + " AS is_relevant FROM rel")
def _(s, d):
    return story.relevance(s, d)


@query("DQ2_no_duplicate_articles", "SELECT sha256(text) AS content_hash, count(*)::BIGINT AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(s, d):
    return cleaning.duplicates(adapters.read(s, d, "documents").select(F.sha2("text", 256).alias("content_hash")), ["content_hash"])


@query("DQ10_accepted_values", "SELECT doc_id, lang FROM documents WHERE lang NOT IN ('en', 'de') OR lang IS NULL")
def _(s, d):
    return cleaning.not_accepted(adapters.read(s, d, "documents").select("doc_id", "lang"), "lang", ["en", "de"])


@query("TXT2_canonical_url", """WITH b AS (SELECT page_id, regexp_replace(trim(url), '#.*$', '') AS u FROM pages), s AS (SELECT page_id, regexp_extract(u, '^[^?]*') AS base,
  list_filter(string_split(regexp_extract(u, '\\?(.*)$', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(lower(p), '^(utm_[^=]*|fbclid|gclid|mc_cid|mc_eid)(=|$)')) AS kept FROM b)
SELECT page_id, lower(regexp_extract(base, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*')) || regexp_replace(base, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url FROM s""")
def _(s, d):
    return adapters.read(s, d, "pages").select("page_id", tx.canonical_url(F.col("url")).alias("url"))


@query("TXT5_article_text", "SELECT doc_id AS article_id, sha256(trim(CASE WHEN contains(lower(coalesce(text, '')), lower(coalesce(source, ''))) THEN coalesce(text, '') ELSE coalesce(source, '') || ' ' || coalesce(text, '') END, ' ')) AS text_hash FROM documents")
def _(s, d):
    return adapters.articles(s, d).select("article_id", F.sha2(tx.article_text(F.col("source_id"), F.col("clean_text")), 256).alias("text_hash"))


@query("VEC2_cosine_similarity", """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), u AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM e), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY 1, 2),
t AS (SELECT label, list(x ORDER BY i) AS topic FROM m GROUP BY 1) SELECT vec_id AS article_id, round(list_cosine_similarity(v, topic), 6) + 0.0 AS similarity FROM e JOIN t USING (label)""")
def _(s, d):
    return adapters.vectors(s, d).join(adapters.topic_vectors(s, d), "label").select("article_id", tx.cosine(F.col("embedding"), F.col("topic")).alias("similarity"))


@query("JN11_dense_grid", ART + """, f AS (SELECT source_id, published AS date, count(*) AS articles FROM art GROUP BY 1, 2), k AS (SELECT DISTINCT source_id FROM f), r AS (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM f), g AS (SELECT * FROM k CROSS JOIN r)
SELECT source_id, date, coalesce(articles, 0)::BIGINT AS articles FROM g LEFT JOIN f USING (source_id, date)""")
def _(s, d):
    counted = adapters.articles(s, d).groupBy("source_id", F.col("published").alias("date")).agg(F.count("*").alias("articles"))
    return news.dense(counted, ["source_id"], ["articles"]).select("source_id", "date", F.col("articles").cast("long").alias("articles"))


@query("JN12_pending_articles", "SELECT DISTINCT doc_id AS article_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE vec_id IS NOT NULL)")
def _(s, d):
    return news.pending(adapters.articles(s, d), adapters.vectors(s, d).select("article_id"))


@query("AGG22_quantities", "SELECT count(DISTINCT source)::BIGINT AS feeds, count(DISTINCT lang)::BIGINT AS languages, count(*)::BIGINT AS articles FROM documents")
def _(s, d):
    return adapters.articles(s, d).agg(F.count_distinct("source_id").alias("feeds"), F.count_distinct("language").alias("languages"), F.count("*").alias("articles"))


@query("SET4_melt", "SELECT o_orderkey, part, round(value, 6) + 0.0 AS value FROM (SELECT o_orderkey, unnest(['total', 'share']) AS part, unnest([o_totalprice::DOUBLE, o_totalprice / 1000.0]) AS value FROM orders)")
def _(s, d):
    wide = adapters.read(s, d, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("total"), (F.col("o_totalprice") / 1000).alias("share"))
    return wide.unpivot("o_orderkey", ["total", "share"], "part", "value")


@query("DQ8_not_null", "SELECT doc_id, lang FROM documents WHERE lang IS NULL")
def _(s, d):
    return cleaning.nulls(adapters.read(s, d, "documents").select("doc_id", "lang"), "lang")


@query("JN13_restrict_to_dates", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem)")
def _(s, d):
    shipped = adapters.read(s, d, "lineitem").select(F.to_date("l_shipdate").alias("date"))
    return portfolio.restricted(adapters.read(s, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date")), shipped)


@query("JN20_null_safe_upsert", """WITH s AS (SELECT source, lang, max(n_chars)::BIGINT AS longest FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY 1, 2), t AS (SELECT source, lang, max(n_chars)::BIGINT AS longest FROM documents GROUP BY 1, 2)
SELECT * FROM s UNION ALL SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.source IS NOT DISTINCT FROM t.source AND s.lang IS NOT DISTINCT FROM t.lang)""")
def _(s, d):
    longest = lambda df: df.groupBy("source", "lang").agg(F.max("n_chars").cast("long").alias("longest"))
    docs = adapters.read(s, d, "documents")
    good = docs.join(adapters.read(s, d, "labels").where("quality = 1").select("doc_id"), "doc_id")
    return cleaning.upsert(longest(docs), longest(good), ["source", "lang"])


# ---- the chain from articles to daily features

COMPONENTS = "source_weight signal_weight weighted_sentiment_component pressure_component"


@query("JN9_article_signals", "WITH " + STORY + f" SELECT topic_id, article_id, date, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in COMPONENTS.split())}, round(pressure_component * u, 6) + 0.0 AS supply_shock_component FROM sgn")
def _(s, d):
    return story.signals(s, d).select("topic_id", "article_id", "date", *COMPONENTS.split(), "supply_shock_component")


@query("TXT6_theme_scores", "WITH " + STORY + " SELECT article_id, round(geopolitical_theme_score, 6) AS geopolitical_theme_score, round(supply_theme_score, 6) AS supply_theme_score, round(weather_theme_score, 6) AS weather_theme_score FROM story")
def _(s, d):
    a = adapters.stories(s, d)
    return a.select("article_id", *(c.alias(n) for n, c in tx.theme_scores(F.col("category"), F.col("title"), F.col("summary"), F.col("clean_text")).items()))


FEATURE_SQL = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in news.FEATURES[2:])


@query("AGG8_daily_news_features", "WITH " + STORY + f" SELECT topic_id, date, news_volume::BIGINT AS news_volume, news_volume::BIGINT AS relevant_news_volume, {FEATURE_SQL} FROM feat0")
def _(s, d):
    return news.daily_features(story.signals(s, d))


@query("WIN25_news_surprise", "WITH " + STORY + " SELECT topic_id, date, round(news_surprise, 6) + 0.0 AS news_surprise FROM feat")
def _(s, d):
    return story.features(s, d).select("topic_id", "date", "news_surprise")


@query("WIN26_news_acceleration", "WITH " + STORY + f" SELECT topic_id, date, news_volume::BIGINT AS news_volume, news_acceleration, {FEATURE_SQL} FROM feat")
def _(s, d):
    return story.features(s, d).drop("relevant_news_volume", "news_surprise")


@query("JN1_article_relevance", "WITH " + STORY + " SELECT r.article_id, topic_id, s.date AS published_date, s.source_id, s.title, round(similarity_score, 6) + 0.0 AS similarity_score, similarity_score >= " + str(story.THRESHOLD) + " AS is_relevant, round(sentiment_score, 6) + 0.0 AS sentiment_score, round(novelty_score, 6) AS novelty_score FROM rel r LEFT JOIN story s USING (article_id) LEFT JOIN feel f USING (article_id)")
def _(s, d):
    return news.article_relevance(story.relevance(s, d), adapters.stories(s, d), adapters.story_sentiment(s, d))


@query("TXT10_normalised_scores", """WITH x AS (SELECT doc_id AS article_id, (doc_id * 37 % 100) / 100.0::DOUBLE AS p, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE (doc_id * 53 % 100) / 100.0::DOUBLE END AS n, CASE WHEN doc_id % 4 < 2 THEN 0 ELSE (doc_id % 10) / 20.0::DOUBLE END AS u FROM documents),
y AS (SELECT *, CASE WHEN (p > 0)::INT + (n > 0)::INT + (u > 0)::INT = 1 AND p + n + u < 1 THEN 1 - p - n - u ELSE 0 END AS rest FROM x), z AS (SELECT article_id, p + CASE WHEN p > 0 OR n > 0 THEN 0 ELSE rest / 2 END AS p, n + CASE WHEN p > 0 OR n > 0 THEN 0 ELSE rest / 2 END AS n, u + CASE WHEN p > 0 OR n > 0 THEN rest ELSE 0 END AS u FROM y)
SELECT article_id, round(CASE WHEN p + n + u > 0 THEN p / (p + n + u) ELSE p END, 6) AS positive, round(CASE WHEN p + n + u > 0 THEN u / (p + n + u) ELSE u END, 6) AS neutral, round(CASE WHEN p + n + u > 0 THEN n / (p + n + u) ELSE n END, 6) AS negative,
  round(CASE WHEN p + n + u > 0 THEN (p - n) / (p + n + u) ELSE p - n END, 6) + 0.0 AS sentiment_score FROM z""")
def _(s, d):
    i = F.col("doc_id")
    item = lambda label, v: F.struct(F.lit(label).alias("label"), v.cast("double").alias("score"))
    scores = F.array(item("POSITIVE", (i * 37 % 100) / 100), item("label_negative", F.when(i % 3 == 0, 0.0).otherwise((i * 53 % 100) / 100)), item("Neutral", F.when(i % 4 < 2, 0.0).otherwise((i % 10) / 20)))
    out = adapters.read(s, d, "documents").select(i.alias("article_id"), tx.normalised_scores(scores).alias("x")).select("article_id", "x.*")
    return out.withColumn("sentiment_score", F.col("positive") - F.col("negative"))


@query("VEC1_embedding_json", "SELECT vec_id AS article_id, round(list_sum(CAST(embedding AS DOUBLE[])), 4) + 0.0 AS total, len(embedding)::BIGINT AS embedding_dimension FROM embeddings")
def _(s, d):
    back = adapters.vectors(s, d).select("article_id", tx.vector_from_json(tx.vector_json(F.col("embedding"))).alias("v"))
    return back.select("article_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("v").alias("embedding_dimension"))


BUCKETS = ", ".join(f"round(coalesce(sum(s) FILTER (i = {k}), 0) / coalesce(nullif(sqrt(sum(s * s)), 0), 1), 6) + 0.0 AS e{k}" for k in range(8))


@query("VEC4_byte_buckets", f"""WITH b AS (SELECT p_partkey, i, ('0x' || substr(hex(encode(p_name)), 2 * i + 1, 2))::INT AS v FROM (SELECT p_partkey, p_name, unnest(range(0, strlen(p_name))) AS i FROM part)),
g AS (SELECT p_partkey, i % 8 AS i, sum(v)::DOUBLE AS s FROM b GROUP BY ALL) SELECT p_partkey, {BUCKETS} FROM g GROUP BY 1""")
def _(s, d):
    return adapters.read(s, d, "part").select("p_partkey", tx.byte_buckets(F.col("p_name")).alias("v")).select("p_partkey", *(F.col("v")[k].alias(f"e{k}") for k in range(8)))


@query("VEC5_create_embeddings", f"""WITH t AS (SELECT doc_id AS article_id, trim(coalesce(text, ''), ' ') AS x FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings WHERE label % 2 = 0)),
b AS (SELECT article_id, i % 8 AS i, sum(('0x' || substr(h, 2 * i + 1, 2))::INT)::DOUBLE AS s FROM (SELECT article_id, h, unnest(range(0, len(h) // 2)) AS i FROM (SELECT article_id, hex(encode(x)) AS h FROM t)) GROUP BY ALL)
SELECT article_id, 8::BIGINT AS embedding_dimension, 'byte-buckets' AS embedding_model, '1' AS embedding_model_version, TIMESTAMP '2024-01-01 00:00:00' AS created_at, {BUCKETS} FROM t LEFT JOIN b USING (article_id) GROUP BY article_id""")
def _(s, d):
    done = adapters.vectors(s, d).select("article_id", F.when(F.col("label") % 2 == 0, "byte-buckets").otherwise("another").alias("embedding_model"))
    now = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    out = embeddings.create_embeddings(adapters.articles(s, d), embeddings.byte_bucket_encoder, "byte-buckets", "1", done, now)
    return out.withColumn("v", tx.vector_from_json(F.col("embedding"))).select(*(c for c in out.columns if c != "embedding"), *(F.col("v")[k].alias(f"e{k}") for k in range(8)))


@query("TXT15_description", "SELECT p_partkey, concat_ws('. ', nullif(p_name, ''), nullif(p_brand, ''), nullif(p_type, ''), 'Symbol ' || p_partkey) AS description FROM part")
def _(s, d):
    return adapters.read(s, d, "part").select("p_partkey", tx.description(F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.concat(F.lit("Symbol "), F.col("p_partkey").cast("string"))).alias("description"))
