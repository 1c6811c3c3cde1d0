"""Point-in-time fundamentals engine on Spark DataFrames."""
