"""Quantitative-research data engine on PySpark DataFrames."""
