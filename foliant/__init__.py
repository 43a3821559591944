"""Spark-native document search and corpus analytics."""
