"""Newsline: a Spark-native engine for news and document streams."""
