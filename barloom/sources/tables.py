"""Reading and writing stored tables: scans, snapshots, incremental windows."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions import text as tx
from barloom.operators.cleaning import align


def scan(spark: SparkSession, path: str, columns: Sequence[str] = (), where: Column | str | None = None) -> DataFrame:
    """Columns and predicate reach the files."""
    df = spark.read.parquet(path)
    df = df.where(where) if where is not None else df
    return df.select(*columns) if columns else df


def scan_csv(spark: SparkSession, path: str, schema: T.StructType, required: Sequence[str] = ()) -> DataFrame:
    """Text columns, multi-line values, then tolerant typing; rows without a required value are dropped. A missing required column raises."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if lacking := sorted(set(required) - set(raw.columns)):
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return align(raw, schema).dropna(subset=list(required) or None, how="any" if required else "all")


def latest_snapshot(spark: SparkSession, pattern: str, schema: T.StructType) -> DataFrame:
    """Rows of the newest dated CSV (…YYYYMMDD.csv, a file or a folder of parts) that has rows; none if none has.

    Only names are listed at first; then files are read from the newest on until one isn't empty.
    """
    paths = [r[0] for r in spark.read.format("binaryFile").load(pattern).select("path").collect()]  # names, no contents
    dated = sorted({(m[1], m[0]) for p in paths if (m := re.match(r".*(\d{8})\.csv(?=/|$)", p))}, reverse=True)
    for day in dict.fromkeys(day for day, _ in dated):
        rows = spark.read.schema(schema).csv([p for d, p in dated if d == day], header=True)
        if not rows.isEmpty():
            return rows
    return spark.createDataFrame([], schema)


def next_window(table: DataFrame, end: str, start: str, date: str = "date") -> DataFrame:
    """One row: the day after the last stored one, or `start` for an empty table, and the exclusive end."""
    return table.agg(F.coalesce(F.date_add(F.max(date), 1), F.lit(start).cast("date")).alias("from_date")).withColumn("to_date", F.lit(end).cast("date"))


def append(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition).parquet(path)


def truncate(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Texts as they are: quotes doubled, line breaks and outer blanks kept. scan_csv() reads the same back, but for empty texts, which come back as NULL."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', quote='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def ensure_table(spark: SparkSession, path: str, schema: T.StructType, partition: Sequence[str] = ()) -> bool:
    """Creates an empty table where there is none; says whether it did."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        return False
    spark.createDataFrame([], schema).write.partitionBy(*partition).parquet(path)
    return True


def wide_to_long(wide: DataFrame, keys: Sequence[str], separator: str = "|") -> DataFrame:
    """Columns named field|symbol become rows (keys, symbol) with one column for each field, names in snake case."""
    pairs = [c.split(separator) for c in wide.columns if separator in c]
    symbols = sorted({s for _, s in pairs})
    fields = sorted({f for f, _ in pairs})
    snake = lambda f: f.strip().lower().replace(" ", "_").replace("adj_close", "adjusted_close")
    each = F.array(*(F.struct(F.lit(s).alias("symbol"), *((F.col(f"`{f}{separator}{s}`") if [f, s] in pairs else F.lit(None)).cast("double").alias(snake(f)) for f in fields)) for s in symbols))
    return wide.select(*keys, F.inline(each))


def price_panel(long: DataFrame, universe: Sequence[str], key: str, value: str, order: str, date: str = "date", require: bool = True) -> DataFrame:
    """A row a date and a column for each name of the universe, in its order: the last value by `order` of each.

    The universe is given, so Spark needs no pass to find the columns and they are the same every time; other names
    are left out before the shuffle. Rows without a date, name or value count for nothing. With `require`, names without
    any value raise. A universe is a list of columns, so it stays small.
    """
    some = long.where(F.col(key).isin(*universe)).where(F.col(date).isNotNull() & F.col(value).isNotNull())
    if require:
        found = {r[0] for r in some.select(key).distinct().collect()}  # at most the universe
        if lacking := sorted(set(universe) - found):
            raise ValueError(f"no prices of {', '.join(lacking)}")
    return some.groupBy(date).pivot(key, list(universe)).agg(F.max_by(value, F.struct(order, value)))


def scan_market_csv(spark: SparkSession, path: str, universe: Sequence[str], price: str = "close", key: str = "symbol") -> DataFrame:
    """A market CSV as a price panel of the universe. Dates and prices that don't parse count as missing; of equal dates the last row by ingested_at, then the highest price."""
    schema = T.StructType([T.StructField(key, T.StringType()), T.StructField("date", T.DateType()), T.StructField(price, T.DoubleType()), T.StructField("ingested_at", T.StringType())])
    return price_panel(scan_csv(spark, path, schema, (key, "date", price)), universe, key, price, "ingested_at")


#: Fields of a feed's item that articles are made of.
ITEM = "title string, link string, guid string, description string, summary string, content string, pubDate string, updated string, created string, _bad_ string"


def published(col: Callable[[str], Column]) -> Column:
    """The first of an item's dates that parses; one without a zone is in UTC."""

    def bare(c: str) -> Column:
        day = F.regexp_replace(F.trim(col(c)), r"^\w{3},\s*", "")
        return F.regexp_replace(F.regexp_replace(day, r"\s+(GMT|UTC|UT|Z)$", " +0000"), r"^(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})$", "$1 +0000")

    return F.coalesce(*(F.try_to_timestamp(bare(c), F.lit(f)) for c in ("pubDate", "updated", "created") for f in ("d MMM yyyy HH:mm:ss Z", "yyyy-MM-dd'T'HH:mm:ssXXX")))


def feed_articles(items: DataFrame, feeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Articles of stored feed items (feed_id, item: one item's XML), and the items that don't parse (feed_id, item, error).

    Feeds are (feed_id, source_id, source, feed_name, category, language, priority, quality); an item of an unknown feed is
    an error too, so none is lost. Titles and texts are cleaned of markup, the text is the content, else the description;
    article_id, content_hash and raw_content_hash are SHA-256 of identity, cleaned and raw content. A NULL item is an error.
    """
    parsed = items.select("feed_id", "item", F.from_xml("item", ITEM, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad_"}).alias("x"))
    known = parsed.join(feeds, "feed_id", "left").withColumn("error", F.when(F.col("item").isNull() | F.col("x").isNull() | F.col("x._bad_").isNotNull(), "malformed item").when(F.col("source_id").isNull(), "unknown feed"))
    field = lambda c: F.nullif(F.col(f"x.{c}"), F.lit(""))
    summary = F.coalesce(field("summary"), field("description"), F.lit(""))
    raw = F.coalesce(field("content"), summary)
    good = known.where("error IS NULL").withColumns({"title": tx.clean_html(F.coalesce(field("title"), F.lit(""))), "url": field("link"), "canonical_url": F.when(field("link").isNotNull(), tx.canonical_url(field("link"))), "published_at": published(field), "summary": tx.clean_html(summary), "clean_text": tx.clean_html(raw), "_raw_": raw})
    low = F.lower("title")
    stamp = F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss")
    good = good.withColumns({"article_id": tx.joined_hash(F.col("source_id"), F.col("canonical_url"), low, stamp), "content_hash": tx.joined_hash(low, F.lower("clean_text")), "raw_content_hash": F.sha2(F.coalesce(F.nullif("_raw_", F.lit("")), F.nullif("summary", F.lit("")), F.col("title")), 256)})
    columns = ("article_id", "source_id", "feed_id", "source", "feed_name", "category", "language", "priority", "quality", "title", "url", "canonical_url", "published_at", "summary", "clean_text", "content_hash", "raw_content_hash")
    return good.select(*columns), known.where("error IS NOT NULL").select("feed_id", "item", "error")


def parse_feed(spark: SparkSession, path: str) -> DataFrame:
    """RSS items as article rows, read by Spark's XML source; the first date that parses counts. feed_articles() gives whole articles of stored items."""
    raw = spark.read.format("xml").option("rowTag", "item").load(path)
    col = lambda c: F.col(c).cast("string") if c in raw.columns else F.lit(None).cast("string")
    return raw.select(col("title").alias("title"), col("link").alias("url"), col("description").alias("summary"), published(col).alias("published_at"))
