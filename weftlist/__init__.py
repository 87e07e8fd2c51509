"""Weftlist: lists out of web pages, on Spark DataFrames."""
