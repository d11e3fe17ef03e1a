"""Incremental document retrieval, ranking and evaluation as Spark plans."""
