"""Memory-retrieval analytics on Spark DataFrames."""
