"""Korpora: Spark-native analytics for translation corpora."""
