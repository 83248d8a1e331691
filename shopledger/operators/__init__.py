"""Cleaners, builders, merges, deletes and filters over DataFrames."""
