"""Retrieval analytics as Spark DataFrame jobs."""
