"""Spark-native analytics for freight-broker communications."""
