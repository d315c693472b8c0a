"""Narrative-trajectory analytics on Spark DataFrames."""
