"""Artifact analytics on Spark DataFrames."""
