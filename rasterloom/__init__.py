"""Image and signal batch processing on Spark DataFrames."""
