"""groundwalk: ranking of the vertices of very large directed graphs, on Spark DataFrames."""
