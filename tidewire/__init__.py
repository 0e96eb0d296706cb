"""Event ingest and operations analytics on Spark DataFrames and streams."""
