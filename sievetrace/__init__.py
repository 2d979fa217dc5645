"""Propose-verify-train data analytics on Spark DataFrames."""
