"""Spark jobs for degradation-series analytics."""
