"""Spark-native business analytics and retrieval engine."""
