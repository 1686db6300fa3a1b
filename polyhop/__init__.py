"""Multi-instance graph analytics on Spark DataFrames."""
