"""Evidence and insight analytics on Spark DataFrames."""
