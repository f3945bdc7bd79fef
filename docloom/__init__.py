"""Document analytics on Spark DataFrames, keyed by document."""
