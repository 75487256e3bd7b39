"""Spark-native knowledge-graph and hybrid-retrieval engine."""
