"""lodestar: neural-retrieval analytics on Spark DataFrames."""
