"""Splitters: configuration, per-fragment kernels and result tables."""
