"""Analytical copies of operational tables, kept fresh and queried with Spark."""
