"""Event-study and volatility analytics on Spark DataFrames."""
