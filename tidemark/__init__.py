"""A Spark-native engine for time-ordered market data."""
