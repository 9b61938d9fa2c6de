"""Spark-first document retrieval analytics and training-data operators."""
