"""Sparse regression and survival analytics on Spark DataFrames."""
