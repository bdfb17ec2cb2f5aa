"""Streaming of the record-linkage library."""
