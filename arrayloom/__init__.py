"""Distributed array analytics on Spark: arrays as DataFrames keyed by integer index."""
