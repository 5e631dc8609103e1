"""Tessella: document mapping and corpus preparation on Spark DataFrames."""
