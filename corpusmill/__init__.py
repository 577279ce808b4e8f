"""Spark-native corpus analytics: preparation, indexing, retrieval, profiling, graphs and event mining as DataFrame jobs."""
