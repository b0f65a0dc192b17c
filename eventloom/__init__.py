"""Event-study and time-series panel analytics on Spark DataFrames."""
