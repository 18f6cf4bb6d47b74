"""Market time-series analytics over Spark DataFrames."""
