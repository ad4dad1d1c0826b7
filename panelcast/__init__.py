"""Grouped panel forecasting on Spark DataFrames."""
