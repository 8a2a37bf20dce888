"""Spark-native surveillance analytics and training-data operators."""
