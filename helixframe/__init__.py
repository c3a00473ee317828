"""Spark-native analytics for ordered three-dimensional point chains and text corpora."""
