"""Spark-native text retrieval, evaluation analytics and corpus curation."""
