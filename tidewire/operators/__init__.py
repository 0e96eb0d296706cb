"""Data-parallel operators over whole DataFrames."""
