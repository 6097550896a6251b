"""Rating analytics on Spark DataFrames."""
