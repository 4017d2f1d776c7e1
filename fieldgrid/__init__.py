"""Geospatial and agro-meteorological analytics on Spark DataFrames."""
