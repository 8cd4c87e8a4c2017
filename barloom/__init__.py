"""Market-data, news and backtest analytics as Spark DataFrame operators."""
