"""Volumes in and out: Parquet tables, dense arrays, fixtures."""
