"""spanforge: interval and event analytics on Spark DataFrames."""
