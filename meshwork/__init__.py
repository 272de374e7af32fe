"""Meshwork: graph analytics on Spark DataFrames, expressed as joins, aggregations and filters."""
