"""millrace: multi-run sensor analytics on Spark DataFrames."""
