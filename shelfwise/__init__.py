"""Retail price-comparison analytics on PySpark DataFrames."""
