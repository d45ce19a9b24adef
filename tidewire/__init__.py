"""Spark-native market-news and price-action analytics."""
