"""Structural code search, rewriting and analysis on Spark DataFrames."""
