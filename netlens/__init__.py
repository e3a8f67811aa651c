"""Network-security analytics on Spark DataFrames."""
