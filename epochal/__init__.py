"""Temporal-fact retrieval, evaluation and corpus analytics on Spark."""
