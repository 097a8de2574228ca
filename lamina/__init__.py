"""Lamina: record analytics on Spark DataFrames."""
