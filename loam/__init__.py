"""loam: corpus analytics on Spark DataFrames."""
