"""Foliant: corpus analytics expressed as Spark DataFrames."""
