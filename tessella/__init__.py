"""Spark-native operators for building, searching and analysing retrieval corpora."""
