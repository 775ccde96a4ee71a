"""Linkloom: record linkage and catalog analytics on Spark DataFrames."""
