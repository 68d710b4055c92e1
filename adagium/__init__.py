"""Adagium: PySpark-native analytics for multilingual short-text corpora."""
