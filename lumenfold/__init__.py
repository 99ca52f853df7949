"""Spark-native document intake, retrieval analytics and corpus preparation."""
