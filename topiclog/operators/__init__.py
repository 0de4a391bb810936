"""Operators of the log over DataFrames."""
