"""Full-text search and review analytics on Spark DataFrames."""
