"""Asset-allocation analytics on Spark DataFrames."""
