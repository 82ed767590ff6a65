"""Text, ranking, vector and event analytics on Spark DataFrames."""
