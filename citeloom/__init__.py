"""Bibliographic analytics as lazy Spark DataFrames."""
