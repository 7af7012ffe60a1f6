"""Operators of a training-data pipeline over whole document, page and vector tables."""
