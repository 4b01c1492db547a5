"""Lodestone: hybrid retrieval, ingestion and evaluation analytics as Spark DataFrame jobs."""
