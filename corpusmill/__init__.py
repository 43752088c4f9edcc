"""Spark-first document retrieval, graph and corpus analytics."""
