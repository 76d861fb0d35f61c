"""Event-case analytics on Spark DataFrames."""
