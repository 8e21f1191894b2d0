"""Spark-native retrieval, agent-data and training-data analytics."""
