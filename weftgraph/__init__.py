"""Property-graph, vector and text analytics on Spark DataFrames."""
