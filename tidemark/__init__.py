"""Search, aggregation and metrics analytics on Spark DataFrames."""
