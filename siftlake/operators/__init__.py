"""Operators over event and graph DataFrames."""
