"""suffixloom: compressed text indexing (run-length multi-string Burrows-Wheeler transforms) with Spark DataFrames."""
