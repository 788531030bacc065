"""Site content analytics on Spark DataFrames."""
