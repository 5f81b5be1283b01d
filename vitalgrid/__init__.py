"""Spark-native cohort, graph-retrieval, reward and evaluation operators."""
