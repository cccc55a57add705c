"""A Spark-native engine for news-style document collections."""
