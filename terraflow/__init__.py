"""Elevation, flood-extent and run analytics on Spark DataFrames."""
