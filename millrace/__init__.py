"""A streaming and batch analytics engine on Spark DataFrames."""
