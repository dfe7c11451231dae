"""Lodestone: a Spark-native engine for retrieval, graph analytics and lifecycle of knowledge records."""
