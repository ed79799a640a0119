"""Audience-measurement analytics on Spark DataFrames."""
