"""Spark-native evidence engine for panel strategies."""
