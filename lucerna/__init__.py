"""Spark-native web-accessibility review over crawl corpora."""
