"""Plans of the record-linkage library."""
