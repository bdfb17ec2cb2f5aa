"""Functions of the record-linkage library."""
