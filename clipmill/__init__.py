"""clipmill: text-collection analytics on Spark DataFrames."""
