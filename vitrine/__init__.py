"""Retrieval, commerce and evaluation analytics as PySpark DataFrame jobs."""
