"""Training-data engine on Spark DataFrames."""
