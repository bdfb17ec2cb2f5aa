"""Sources of the record-linkage library."""
