"""Catalogue-quality analytics on Spark DataFrames."""
