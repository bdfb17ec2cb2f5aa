"""Operators of the record-linkage library."""
