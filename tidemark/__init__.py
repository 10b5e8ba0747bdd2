"""Spark-native analytics over the durable state of long-running work."""
