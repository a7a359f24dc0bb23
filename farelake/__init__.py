"""Booking and fare analytics on Spark DataFrames."""
