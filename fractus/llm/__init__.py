"""Operators of a training-data pipeline: texts, tokens, pages and media columns."""
