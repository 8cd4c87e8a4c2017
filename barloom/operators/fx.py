"""Currency conversion: which quoted pair serves which conversion, and prices in a reference currency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.windows import asof


def resolved(currencies: DataFrame, quotes: DataFrame, reference: str) -> tuple[DataFrame, DataFrame]:
    """(currency, date, rate, route) of the currencies that a quoted pair converts to `reference`, and (currency, error) of the others.

    quotes are (base, quote, date, rate): a unit of base in quote. A direct pair wins over the inverse one, whose rates
    are inverted; a pair counts if it has one positive rate. The reference itself needs none. NULL is a currency that
    can't be converted.
    """
    wanted = currencies.select("currency").distinct().where(F.col("currency").isNull() | (F.col("currency") != reference))
    sound = quotes.where("rate > 0")
    direct = sound.where(F.col("quote") == reference).select(F.col("base").alias("currency"), "date", "rate", F.lit("direct").alias("route"))
    inverse = sound.where(F.col("base") == reference).select(F.col("quote").alias("currency"), "date", (1 / F.col("rate")).alias("rate"), F.lit("inverse").alias("route"))
    served = direct.select("currency").distinct()
    both = direct.unionByName(inverse.join(served, "currency", "left_anti")).join(wanted, "currency", "left_semi")
    lacking = wanted.join(both.select("currency").distinct(), "currency", "left_anti")
    said = F.concat(F.lit("no rate from "), F.coalesce("currency", F.lit("an unknown currency")), F.lit(f" to {reference}"))
    return both, lacking.select("currency", said.alias("error"))


def converted(prices: DataFrame, quotes: DataFrame, reference: str, max_rows: int = 5) -> tuple[DataFrame, DataFrame]:
    """(symbol, currency, date, price, rate, converted) and the currencies without a rate, whose prices are left out rather than guessed.

    A rate is carried forward over at most max_rows dates of the union of a currency's prices and quotes, never back;
    older ones leave `converted` NULL. Prices in the reference stay as they are, at rate 1.
    """
    rates, lacking = resolved(prices, quotes, reference)
    same = prices.where(F.col("currency") == reference).select("symbol", "currency", "date", "price", F.lit(1.0).alias("rate"), F.col("price").alias("converted"))
    other = prices.select("symbol", "currency", "date", "price").join(rates.select("currency").distinct(), "currency", "left_semi")
    known = asof(other, rates.groupBy("currency", "date").agg(F.max("rate").alias("rate")), ["currency"], "rate", max_rows)
    return same.unionByName(known.select("symbol", "currency", "date", "price", "rate", (F.col("price") * F.col("rate")).alias("converted"))), lacking
