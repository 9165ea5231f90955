"""Extreme-weather analytics on Spark DataFrames."""
