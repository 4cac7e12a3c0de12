"""Splitting fragments as they arrive."""
