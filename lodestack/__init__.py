"""Spark-native document analytics: corpus processing, retrieval, activity analytics and enrichment."""
