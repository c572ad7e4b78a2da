"""Labelled-corpus analytics on Spark DataFrames."""
