"""Fold-safe feature, ensemble and evaluation operators for token tables on Spark."""

__version__ = "0.1.0"
