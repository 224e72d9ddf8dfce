"""Spark-native engine for filesystem-trace datasets."""
