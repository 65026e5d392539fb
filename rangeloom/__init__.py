"""rangeloom: interval-set and feed analytics on Spark DataFrames."""
