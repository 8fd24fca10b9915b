"""Spark jobs for large panels of time series."""
