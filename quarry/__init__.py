"""Corpus building, retrieval and evaluation as Spark DataFrame jobs."""
