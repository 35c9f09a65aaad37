"""Tessera: a Spark-native engine for grounded document retrieval."""
