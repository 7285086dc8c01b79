"""Spark-native document, conversation and retrieval engine."""
