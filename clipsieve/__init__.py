"""Trajectory curation and analytics on Spark DataFrames."""
