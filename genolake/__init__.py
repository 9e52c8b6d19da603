"""Positional genomics on Spark: site tables, interval joins, filters, false-discovery rates, burdens and their models."""

__version__ = "0.1.0"
