"""Spatial hierarchies over weighted point sets, declared as Spark DataFrames."""
