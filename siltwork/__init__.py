"""Siltwork: media-curation analytics on Spark DataFrames."""
