"""Spark-native geospatial search and enrichment."""
