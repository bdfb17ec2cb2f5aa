"""Metadata record linkage and deduplication as Spark DataFrame operators."""
