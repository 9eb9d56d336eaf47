"""Price analytics on Spark DataFrames."""
