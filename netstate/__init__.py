"""Network-state analytics on Spark: change logs in, DataFrames out."""
