"""Market-style time series analytics as DataFrame operators on Spark."""
