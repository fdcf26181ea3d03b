"""Bibliometric text mining and categorical trend inference on Spark DataFrames."""
