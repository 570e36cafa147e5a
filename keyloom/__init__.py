"""Keyed-row analytics and near-duplicate source text on Spark DataFrames."""
